"""Operators 11 to 13 against brute force, a plain program and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from ridgeline.llm import divergence, records, repair
from ridgeline.session import ensure_checkpoint_dir

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


# Operator 11

def plain_divergences(rows, least=3, top=200):
    lang, out = defaultdict(lambda: defaultdict(Counter)), []
    docs = defaultdict(Counter)
    for text, la, so in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        lang[la or ""][so or ""].update(found)
        docs[la or ""].update(set(found))
    for la, groups in lang.items():
        kept = [t for t, n in docs[la].items() if n >= least]
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        q = share(sum(groups.values(), Counter()))
        p = {g: share(c) for g, c in groups.items()}
        for g in groups:
            pairs = [(sum((p[g][t] - p[h][t]) ** 2 // p[h][t] for t in kept), h) for h in groups if h != g]
            terms = [((p[g][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[g][t] and p[g][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                out += [(la, g, part, x, v, k + 1) for k, (v, x) in enumerate(sorted(found, key=lambda y: (-y[0], y[1].encode()))[:limit])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(16, 16_384), (2, 3)])
def test_divergences(spark, edge_rows, blocks):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcéß中" for b in "xyzÀA"] + ["the", "<b>", "don't", "\x00n\x7f"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", "", None])) for _ in range(150)]
    rows += [(t, "xx", "long") for _, t in edge_rows] + [("lone words only", "yy", "a"), (None, "yy", "b"), ("", "yy", "c"), ("alone", "zz", "q")] + rows[:5]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as doc_id", "'x' as term", "2 as times", "3 as block", "4 as value")
    got = divergence.divergences(df, block_groups=blocks[0], block_terms=blocks[1]).collect()
    assert sorted(map(tuple, got)) == plain_divergences(rows)
    assert divergence.divergences(df.limit(0)).count() == 0


def test_shares_are_exact(spark):
    rng = random.Random(1)
    pairs = [(c, c + rng.randint(0, 10 ** rng.randint(0, 15))) for c in (rng.randint(1, 10 ** rng.randint(1, 15)) for _ in range(300))]
    want = [1 + 10 ** 9 * c // n for c, n in pairs]
    count, of = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    assert divergence.shares(count, of).tolist() == want
    df = spark.createDataFrame([(c, n, w) for (c, n), w in zip(pairs, want, strict=True)], "c bigint, n bigint, w bigint")
    assert df.filter(divergence.share(df["c"], df["n"]) != df["w"]).isEmpty()


# Operator 12

def plain_repair(rows):
    """(report, repaired digest) of rows (turn, role, text) in order: the least
    (cost, audit) over all edits, found backwards."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}
    n = len(rows)
    best = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        options = {}
        for s, to in states.items():
            found = [(0, "", ())] if i == n and s in ("", "a") else []
            if i < n:
                _, role, text = rows[i]
                more = 3 * (faults[i] == "truncated")
                c, w, lines = best[i + 1][s]
                found.append((c + 4, "D" + w, lines))
                if faults[i] not in ("blank", "duplicate"):
                    for name, cost, new in [("K", 0, role)] + [("R", 3, full[x]) for x in to if x in full]:
                        if new[:1] in to:
                            c, w, lines = best[i + 1][to[new[:1]]]
                            found.append((c + cost + more, name + w, (f"{new}:{text}", *lines)))
            options[s] = found
        now = {s: min(found, default=(10 ** 9, "", ())) for s, found in options.items()}
        for _ in range(4):
            for s, to in states.items():
                for x in full:
                    if x in to:
                        c, w, lines = now[to[x]]
                        now[s] = min(now[s], (c + 3, "I" + w, (f"{full[x]}:", *lines)))
        best[i] = now
    cost, audit, lines = best[0][""]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = Counter(faults)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(conversations):
    out = {}
    for conv, turn, role, text in conversations:
        spaced = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        rows = out.setdefault(conv, [])
        role, text = spaced[2], spaced[3]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    by = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    return {c: sorted(rows, key=by) for c, rows in out.items()}


def made_up(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "open end", "", " \t\n", "Why? ", "ends\x0b", None, "é。", "x" * 3000 + ".", "a.\x1c"]
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 30])):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]), rng.choice(texts + [f"t{turn}.", f"u{turn}"])))
    return rows


@pytest.mark.parametrize("bits", [12, 2, 0])
def test_repair(spark, monkeypatch, bits):
    """With 4 rows or 1 in a chunk most conversations span chunks."""
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rows = made_up(bits, 60) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None)]
    long = random.Random(3)
    rows += [(777, t, long.choice(["user", "assistant"]), long.choice(["Go.", f"step {t}.", "cut"])) for t in range(200)]
    rows += rows[:4]  # repeated rows
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' as conv", "1 as g", "2 as at", "3 as fault", "4 as kind")
    want = {c: plain_repair(r) for c, r in plain_damage(rows).items()}
    got = {r[0]: tuple(r[1:]) for r in repair.damage_report(df).collect()}
    assert got == want
    assert repair.damage_report(df.limit(0)).count() == 0


def test_repair_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = {c: plain_repair(r) for c, r in plain_damage([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]).items()}
    got = repair.damage_report(df)
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_repaired_rows_are_legal(spark):
    rows = [(1, t, r, f"{t}.") for t, r in enumerate(["assistant", "user", "user", "system", "assistant", "tool"])]
    _, repaired = repair.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    found = repaired.orderBy("g", "pos").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in found))
    assert all(r.text == "" for r in found if r.edit == "I")


# Operator 13

def library_records(rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORD_BPE)
    return [(d, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]


@pytest.fixture
def folder(spark, tmp_path):
    return f"{ensure_checkpoint_dir(spark)}/{tmp_path.name}-records"


def test_records(spark, edge_docs, edge_rows, folder):
    records.write_records(edge_docs, WORD_BPE, folder, file_bytes=3000, task_bytes=60_000)
    index = records.build_index(spark, folder).collect()
    want = sorted(library_records(edge_rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len({r.shard for r in index}) > 3
    read = records.read_records(spark, folder).orderBy("shard", "record").collect()
    assert [r.doc_id for r in read] == [d for d, _ in want]
    assert sorted((r.doc_id or -1, r.ids) for r in read) == sorted((d or -1, i) for d, i in want)
    start, got = 0, records.digests(spark, folder).orderBy("start").collect()
    for r, x in zip(got, read, strict=True):
        assert tuple(r) == (x.doc_id, start, len(x.ids), zlib.crc32(np.array(x.ids, "<u4").tobytes()))
        start += len(x.ids)


def test_shuffled_reads(spark, edge_docs, folder):
    records.write_records(edge_docs, WORD_BPE, folder, file_bytes=3000)
    records.build_index(spark, folder)
    plain, one, two, same = (records.read_records(spark, folder, s).select("doc_id", "ids").collect() for s in (None, 1, 2, 1))
    assert one == same and one != two
    key = lambda r: (r.doc_id or -1, r.ids)
    assert sorted(one, key=key) == sorted(two, key=key) == sorted(plain, key=key)


def test_no_records(spark, no_docs, folder):
    assert records.round_trip(no_docs, WORD_BPE, folder).count() == 0
    assert records.read_records(spark, folder, 3).count() == 0


def test_frames():
    ids = np.array([5, 1, 65535], "<u2").tobytes()
    data = records.frame(-7, ids, 2) + b"\n" + records.frame(None, b"", 4) + b"\n"
    entries = records.entries(memoryview(data))
    assert [(r, d, n) for r, d, _, _, _, n in entries] == [(0, -7, 3), (1, None, 0)]
    assert records.unpacked(records.payload_at(memoryview(data), entries[0][2]))[1].tolist() == [5, 1, 65535]
    for i in range(len(data)):  # any changed byte is found, and so is any cut
        with pytest.raises(ValueError):
            records.entries(memoryview(data[:i] + bytes([data[i] ^ 1]) + data[i + 1:]))
    for i in range(1, len(data)):
        if i != entries[1][2]:
            with pytest.raises(ValueError):
                records.entries(memoryview(data[:i]))


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer
    tok, own = Tokenizer.from_file(WORD_BPE), records.Encoder(WORD_BPE)
    odd = ["Don't STOP'S we'Ll", "naïve ÀÉÎ ª º µ ² ³ ¼ 12³4", "a\x1cb \x1f\x85x\xa0y", "İstanbul ΣΑΣ ſ K", "é é ́x", "<|endoftext|>x <|startoftext|>", "<| a", "中文 テスト 😀👍🏽", "\x00\x7f~~~!!--", "", "   ",
           "x" * 3000, "1234567890", "'s 't ''s", "ß ẞ ﬁ Ǆ", "a b　c​d"]
    rng = random.Random(0)
    odd += ["".join(rng.choices("aAzZéÉ0 9'.,-\n\t\x1c\xa0ß İ中😀<|sStT", k=40)) for _ in range(400)]
    for x in odd:
        assert np.frombuffer(own(x), own.kind).tolist() == tok.encode(x, add_special_tokens=False).ids, x
