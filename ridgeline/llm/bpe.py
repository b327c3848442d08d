"""Operator 9: byte-pair encoding and decoding.

A word's symbols form a doubly linked list; a heap of (rank, position) holds
the adjacent pairs that can merge.  Popped entries whose pair has changed since
are stale and skipped.  Decoding concatenates vocabulary strings.  Words repeat,
so a worker remembers the pieces it has encoded, in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm import util, words

_STATE: dict[str, "Bpe"] = {}
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_SHIFT = 32


class Bpe:
    """Encoder and decoder of a byte-level BPE file (vocabulary and merges)."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: left id and right id -> rank and merged id
        self.merges = {(vocab[a] << _SHIFT) | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        chars = words.byte_chars()
        self.byte_ids = [vocab[c] for c in chars]
        of = {c: b for b, c in enumerate(chars)}
        self.strings = {i: bytes(of[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.word_table = words.Table(self.word_ids, 500_000)
        self.first = words.Table(self._digest, 20_000)
        self.rest = words.Table(lambda part: None if words.open_ended(part) else self._digest(" " + part), 500_000)

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        merges, get = self.merges, self.byte_ids.__getitem__
        ids = [*map(get, word.encode())]
        n = len(ids)
        heap = []
        for i in range(n - 1):
            m = merges.get((ids[i] << _SHIFT) | ids[i + 1])
            if m:
                heap.append((m[0], i, m[1], ids[i], ids[i + 1]))
        if not heap:
            return tuple(ids)
        heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while heap:
            _, i, merged, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                m = merges.get((merged << _SHIFT) | ids[k])
                if m:
                    heappush(heap, (m[0], i, m[1], merged, ids[k]))
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h] << _SHIFT) | merged)
                if m:
                    heappush(heap, (m[0], h, m[1], ids[h], merged))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for s in self.cut(text) if self.cut else [text]:
            if s in self.special:
                out.append(self.special[s])
            else:
                for w in self.split(s):
                    out += self.word_table[w]
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    def _digest(self, piece: str) -> tuple[str, int, bytes]:
        """Decimal ids, their number, and the bytes that they decode to."""
        ids = self.encode(piece)
        return ",".join(map(str, ids)), len(ids), b"".join(map(self.strings.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
        parts = text.split(" ")
        got = [self.first[parts[0]], *map(self.rest.__getitem__, parts[1:])]
        if None in got or len(parts) > 1 and words.open_ended(parts[0]):
            got = [*map(self.first.__getitem__, words.pieces(text))]
        ids = ",".join([x[0] for x in got if x[1]])
        decoded = b"".join([x[2] for x in got]).decode("utf-8", "replace")
        return sum([x[1] for x in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def of(path: str) -> Bpe:
    return _STATE.get(path) or _STATE.setdefault(path, Bpe(path))


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row; null text: no ids."""
    def run(batches):
        bpe = of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])
    return util.texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    def run(batches):
        bpe = of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])
    return rows.select(rows["doc_id"].cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; one row of digests per row of ``docs``.

    Null texts count as empty: 0 tokens and the digest of the empty string.
    A null doc_id stays null, repeated rows each give a row, other columns are
    ignored, very long words cost n log n heap steps.
    """
    def run(batches):
        bpe = of(path)
        for b in batches:
            got = [bpe.digests(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return util.texts(docs).mapInArrow(run, SCHEMA)
