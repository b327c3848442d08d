"""Operator 1: best-fit packing of token sequences.

Documents are encoded in Arrow batches; a piece table (numbers only, no text)
is written once and dealt by hash over as many partitions as it needs.  Each
partition packs its pieces online, each Arrow batch longest first: a fixed number of open bins, filed by free
space; a bitset of the free spaces in use finds the fullest bin that still
takes a piece.  When too many are open, the fullest closes.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import util, words

SEQUENCE_TOKENS, END_ID = 1024, 2
#: Open bins of a packer, and pieces a packing task takes.
OPEN_BINS, TASK_PIECES = 8192, 400_000
_STATE: dict[str, object] = {}

PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class Encoder:
    """text -> its ids as little-endian unsigned 32-bit bytes, equal to the
    tokenizers library's.  Words are encoded by the library's own model, one
    piece at a time, and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.chars = words.byte_chars()
        self.word_table = words.Table(self._word)
        self.first = words.Table(self._piece, 50_000)
        self.rest = words.Table(lambda part: None if words.open_ended(part) else self._piece(" " + part))

    def _word(self, word: str) -> bytes:
        mapped = "".join(map(self.chars.__getitem__, word.encode()))
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if any(s in piece for s in self.special):
            ids = self.tok.encode(piece, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.word_table.__getitem__, self.split(piece)))

    def __call__(self, text: str) -> bytes:
        head, *tail = text.split(" ")
        if not tail:
            return self._piece(text)
        got = [*map(self.rest.__getitem__, tail)]
        if None in got or words.open_ended(head):
            return b"".join(map(self.first.__getitem__, words.pieces(text)))
        return self.first[head] + b"".join(got)


def cut(n: int, size: int = SEQUENCE_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be short."""
    k = -(-n // size)
    first = n - size * (k - 1)
    return [(0, first)] + [(first + size * i, size) for i in range(k - 1)]


class Packer:
    """Bounded-space best fit over bins of ``size`` tokens."""

    def __init__(self, size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS):
        self.size, self.open_bins = size, open_bins
        self.by_space: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.n_open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length`` tokens."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.size, self.made
            self.made += 1
        left = space - length
        if left:
            self.by_space[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.size - space

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.n_open -= 1
        return number


def encode_pieces(docs: DataFrame, path: str, size: int = SEQUENCE_TOKENS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document (null text: only the end id).  ``keep_ids``
    adds the ids themselves (array of int) for writers of training files."""
    end = struct.pack("<I", end_id)

    def run(batches):
        encode = _STATE.get(path) or _STATE.setdefault(path, Encoder(path))
        for batch in batches:
            rows: list[list] = [[] for _ in range(7 if keep_ids else 6)]
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text) + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    own = ids[4 * start: 4 * (start + length)]
                    for out, x in zip(rows, (doc, row, i, start, length, zlib.crc32(own), list(struct.unpack(f"<{length}I", own)) if keep_ids else None), strict=False):
                        out.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names[: len(rows)])

    numbered = util.texts(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return numbered.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


def place(pieces: DataFrame, size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Give each piece a sequence and its offset there.  ``pieces`` is a
    written table: its rows are counted first, so that a task takes about
    ``task_pieces`` of them however many there are."""
    tasks = max(1, -(-pieces.count() // task_pieces))
    order = F.xxhash64("doc_id", "row", "piece")
    dealt = pieces.withColumn("h", order).repartition(tasks, "h").sortWithinPartitions("h", "row", "piece").drop("h", "row")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, base = Packer(size, open_bins), TaskContext.get().partitionId() << 40
        for frame in frames:
            frame = frame.sort_values("length", ascending=False, kind="stable")
            at = [packer.put(n) for n in frame["length"].tolist()]
            yield frame.assign(sequence_id=[base + b for b, _ in at], offset=[o for _, o in at])

    return dealt.mapInPandas(run, PACKED)


def pack(docs: DataFrame, path: str, size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    Rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Null
    and empty texts are one piece with the end id; repeated rows and null
    doc_ids are packed like others; an empty table gives no rows; other
    columns are ignored.
    """
    return place(util.written(encode_pieces(docs, path, size)), size, open_bins)
