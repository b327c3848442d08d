"""Operators 1, 2 and 9 against the tokenizers library."""

import hashlib
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridgeline.llm import bpe, packing, token_counts, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
COUNT = token_counts.counter(PATH)


def ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


ODD = st.lists(st.sampled_from(list("ab Z9'é😀\n\t\r\u00a0\u3000\x1c\x85_-.<|>") + ["<|endoftext|>", "  ", "'ll", " the"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_encoders_equal_the_library(text):
    encode = packing._STATE.setdefault(PATH, packing.Encoder(PATH))
    got = encode(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids(text)
    b = bpe.of(PATH)
    assert b.encode(text) == ids(text)
    assert b.digests(text) == (len(ids(text)), hashlib.sha256(",".join(map(str, ids(text))).encode()).hexdigest(),
                               hashlib.sha256(TOK.decode(ids(text), skip_special_tokens=False).encode()).hexdigest())
    assert "".join(words.pieces(text)) == text
    assert token_counts.count_pieces([token_counts.cut_text(text)], COUNT, {}) == [len(ids(text))]


def test_tables_are_bounded():
    made = []
    t = words.Table(lambda p: made.append(p) or len(p), limit=3)
    assert [t[p] for p in ("a", "bb", "a", "ccc", "dddd", "a")] == [1, 2, 1, 3, 4, 1]
    assert len(t) <= 3 and len(made) == 5
    t["y" * 500]
    assert "y" * 500 not in t


def test_token_counts(edge_docs, edge_rows):
    rows = token_counts.token_counts(edge_docs, PATH).collect()
    want = sorted(((d is None, d or 0, len((t or "").encode()), len(ids(t))) for d, t in edge_rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


def test_token_counts_of_sentencepiece(edge_docs):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = edge_docs.filter("doc_id in (4, 9, 16)")
    want = {r.doc_id: len(sp.encode(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()} == want


def test_round_trip(edge_docs, edge_rows):
    rows = bpe.round_trip(edge_docs, PATH).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((d is None, d or 0, len(ids(t)), sha(",".join(map(str, ids(t)))), sha(t or "")) for d, t in edge_rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    texts = bpe.decode_ids(bpe.encode_texts(edge_docs, PATH), PATH).collect()
    assert sorted(r.text for r in texts) == sorted(t or "" for _, t in edge_rows)


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 2049, 5000])
def test_cut(n):
    got = packing.cut(n)
    assert sum(x for _, x in got) == n and all(x == 1024 for _, x in got[1:]) and 1 <= got[0][1] <= 1024
    assert [s for s, _ in got] == [sum(x for _, x in got[:i]) for i in range(len(got))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_packer_is_bounded_best_fit(lengths, open_bins):
    p = packing.Packer(50, open_bins)
    bins, still = defaultdict(int), set()
    for n in lengths:  # brute force over the open bins
        fits = [b for b in still if 50 - bins[b] >= n]
        b, offset = p.put(n)
        assert bool(fits) == (b in still)
        if fits:
            assert bins[b] == max(bins[x] for x in fits)
        assert offset == bins[b]
        bins[b] += n
        still.add(b)
        still = {x for s in p.by_space for x in s}
        assert all(bins[x] < 50 for x in still) and len(still) == p.n_open <= open_bins
    assert all(v <= 50 for v in bins.values())


def test_pack(edge_docs, edge_rows):
    rows = packing.pack(edge_docs.filter("doc_id <> 15"), PATH).collect()
    texts = {d: ids(t) + [2] for d, t in edge_rows if d not in (15, None)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *texts[r.doc_id][r.start:r.start + r.length]))
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert {d: sum(x[2] for x in v) for d, v in by_doc.items()} == {d: len(v) for d, v in texts.items()}
    for s in by_seq.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= 1024
    total = sum(map(len, texts.values()))
    assert len(by_seq) <= -(-total // 1024) + 1


def test_empty_tables(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
    assert token_counts.token_counts(no_docs, PATH).count() == 0
    assert bpe.round_trip(no_docs, PATH).count() == 0
