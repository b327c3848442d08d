"""Operator 13: token ids as length-delimited binary records.

A frame is: length of the payload (unsigned 64 bits), masked checksum of that
length (32 bits), the payload, its masked checksum (32 bits), a line feed; all
little-endian.  The payload is: doc_id (signed 64 bits), one byte (bytes of an
id: 2 or 4; plus 128 if the doc_id is null), then the ids.  Checksums are CRC-32,
rotated right by 15 bits plus a constant, so that a checksum stored in checked
data does not look like its own.

``write_records`` deals the texts by ranges of doc_id, encodes them where they
are sorted, and lets Spark's own committed writer lay the frames into files of
bounded size (``data/shard=N``, in ascending order): a lost executor's task is
written anew, and the folder may lie in any store.  ``build_index`` walks the
files, checks every frame, and writes a separate table of offsets (``index``);
``read_records`` takes the records at these offsets, in their order or, with a
seed, in a shuffled one.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm import util, words

END_ID = 2
#: A new file starts once one holds so many bytes; text bytes of a writing task.
FILE_BYTES, TASK_BYTES = 16 << 20, 32 << 20
#: Rows that a writing task encodes at a time.
TASK_ROWS = 1000
#: Pieces of text, and words in them, that a worker remembers.
HELD_PIECES, HELD_WORDS = 250_000, 400_000
#: Index entries that may be broadcast (16 bytes each).
BROADCAST_ENTRIES = 1_000_000
# Fixed value: what a rotated checksum is raised by.
MASK = 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
_DOC = struct.Struct("<qB")
_STATE: dict[str, "Encoder"] = {}
INDEX = "shard bigint, record bigint, doc_id bigint, offset bigint, length bigint, start bigint, n_tokens bigint"


def masked(data) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """A frame but for its closing line feed, which Spark's text writer adds."""
    payload = _DOC.pack(doc_id or 0, width | (128 if doc_id is None else 0)) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload))))


def payload_at(data: memoryview, at: int) -> memoryview:
    """The checked payload of the frame at ``at``."""
    if at + HEAD.size > len(data):
        raise ValueError(f"cut frame at byte {at}")
    size, check = HEAD.unpack_from(data, at)
    if masked(data[at:at + 8]) != check:
        raise ValueError(f"damaged length at byte {at}")
    end = at + HEAD.size + size
    if end + TAIL.size + 1 > len(data):
        raise ValueError(f"cut frame at byte {at}")
    payload = data[at + HEAD.size:end]
    if masked(payload) != TAIL.unpack_from(data, end)[0] or data[end + TAIL.size] != 10:
        raise ValueError(f"damaged frame at byte {at}")
    return payload


def entries(data: memoryview) -> list[tuple]:
    """(record, doc_id, offset, length, start, n_tokens) of every frame of a file."""
    rows, at, start = [], 0, 0
    while at < len(data):
        payload = payload_at(data, at)
        doc, kind = _DOC.unpack_from(payload)
        n = (len(payload) - _DOC.size) // (kind & 127)
        size = len(payload) + HEAD.size + TAIL.size + 1
        rows.append((len(rows), None if kind & 128 else doc, at, size, start, n))
        at, start = at + size, start + n
    return rows


def unpacked(payload: memoryview) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a payload."""
    doc, kind = _DOC.unpack_from(payload)
    return None if kind & 128 else doc, np.frombuffer(payload[_DOC.size:], f"<u{kind & 127}")


class Encoder:
    """text -> packed ids, equal to the tokenizers library's, for vocabularies
    that drop white space: a text is cut there, and pieces are remembered.
    Pieces of Latin letters are cut into words, which the library's own model
    encodes; all others go through the whole library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(split["pattern"]["Regex"]).findall
        self.width = 2 if max(self.tok.get_vocab_size(with_added_tokens=True), END_ID) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.model, self.chars = self.tok.model, words.byte_chars()
        #: How the special tokens begin.
        self.special = [t.content[:2] for t in self.tok.get_added_tokens_decoder().values()]
        self.word_table, self.pieces = words.Table(self._word, HELD_WORDS), words.Table(self._piece, HELD_PIECES)
        self.cut = regex.compile(f"[{words.WHITE}]+").split
        self.odd = regex.compile("[\x1c-\x1f]").search

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _word(self, word: str) -> bytes:
        return self._packed([t.id for t in self.model.tokenize("".join(map(self.chars.__getitem__, word.encode())))])

    def _piece(self, piece: str) -> bytes:
        try:
            piece.encode("latin-1")
        except UnicodeEncodeError:
            return self._packed(self.tok.encode(piece, add_special_tokens=False).ids)
        # Letters of Latin-1 are composed already and lower-cased one by one.
        if piece.isalpha():
            return self.word_table[piece.lower()]
        if piece[:-1].isalpha() and not piece[-1].isalnum():
            return self.word_table[piece[:-1].lower()] + self.word_table[piece[-1]]
        if any(x in piece for x in self.special):
            return self._packed(self.tok.encode(piece, add_special_tokens=False).ids)
        return b"".join(map(self.word_table.__getitem__, self.words_of(piece.lower())))

    def __call__(self, text: str) -> bytes:
        # str.split() also cuts at four control characters that are no white space here.
        return b"".join(map(self.pieces.__getitem__, self.cut(text) if self.odd(text) else text.split()))


def _encoder(path: str) -> Encoder:
    return _STATE.get(path) or _STATE.setdefault(path, Encoder(path))


def _forget() -> None:
    """A worker that reads needs no encoder, whose tables it may hold since it wrote."""
    _STATE.clear()
    pa.default_memory_pool().release_unused()


def write_records(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES, task_bytes: int = TASK_BYTES) -> None:
    """Write one record per row of ``docs`` to ``folder``/data, by ascending
    doc_id (nulls first; rows of one doc_id by the hash of their text).

    Null texts are records of the end id alone; repeated rows each are one; an
    empty table gives a folder without files; other columns are ignored.  A
    text of any length is one record; a file ends with the record that reaches
    ``file_bytes``.
    """
    texts = util.texts(docs)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    dealt = (texts.select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")
             .repartitionByRange(max(1, -(-total // task_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text"))

    def run(batches):
        encode = _encoder(path)
        end = np.array([end_id], encode.kind).tobytes()
        shard, at, pos = TaskContext.get().partitionId() << 20, 0, 0
        for b in (whole.slice(i, TASK_ROWS) for whole in batches for i in range(0, whole.num_rows, TASK_ROWS)):
            shards, places, frames = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = frame(doc, encode(text) + end, encode.width)
                shards.append(shard)
                places.append(pos)
                frames.append(f)
                at, pos = at + len(f) + 1, pos + 1
                if at >= file_bytes:
                    shard, at = shard + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(places, pa.int64()), pa.array(frames, pa.binary())], ["shard", "pos", "frame"])

    framed = dealt.mapInArrow(run, "shard bigint, pos bigint, frame binary").sortWithinPartitions("shard", "pos")
    # The cast keeps the bytes as they are; nothing but the writer sees them.
    framed.select("shard", F.col("frame").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(f"{folder}/data")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, content), one row per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data")
    return files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("bigint").alias("shard"), "content")


def build_index(spark: SparkSession, folder: str) -> DataFrame:
    """Read every file, check every frame, and write ``folder``/index: shard,
    record (number in the file), doc_id, offset and length of the frame, start
    (ids before it in the file) and n_tokens.  Damage raises an error."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches):
        _forget()
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cols = [*zip(*entries(memoryview(content.as_buffer())), strict=True)]
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(cols[0]), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names)

    _files(spark, folder).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _taken(index: DataFrame, folder: str, order, make, schema: str, kinds: list) -> DataFrame:
    """``make(doc_id, ids)`` -> values for every indexed record; the records of
    a file are taken in ``order``."""
    entries = F.sort_array(F.collect_list(F.struct(order.alias("o"), "record", "offset", "start")))
    by_file = index.groupBy("shard").agg(entries.alias("e")).select("shard", *[F.col(f"e.{c}").alias(c) for c in ("record", "offset", "start")])
    if index.count() <= BROADCAST_ENTRIES:
        by_file = F.broadcast(by_file)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        _forget()
        for b in batches:
            for i in range(b.num_rows):
                data = memoryview(b.column(1)[i].as_buffer())
                records, offsets, starts = (b.column(c)[i].as_py() for c in (2, 3, 4))
                for k in range(0, len(offsets), 4096):
                    got = [make(*unpacked(payload_at(data, at))) for at in offsets[k:k + 4096]]
                    own = [pa.array(x, kind) for x, kind in zip(zip(*got, strict=True), kinds, strict=True)]
                    n = len(got)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column(0)[i].as_py()] * n, pa.int64()), pa.array(records[k:k + n], pa.int64()), pa.array(starts[k:k + n], pa.int64()), *own], ["shard", "record", "start", *names])

    files = _files(index.sparkSession, folder).join(by_file, "shard").select("shard", "content", "record", "offset", "start")
    return files.mapInArrow(run, f"shard bigint, record bigint, start bigint, {schema}")


def read_records(spark: SparkSession, folder: str, seed: int | None = None) -> DataFrame:
    """(shard, record, doc_id, ids) of every record, at the offsets of the
    index.  With a seed the rows come in an order shuffled over all files;
    another seed gives another order."""
    util.ship(spark)
    index = read_index(spark, folder)
    by = F.col("record") if seed is None else F.xxhash64(F.lit(seed), "shard", "record")
    rows = _taken(index, folder, by, lambda doc, ids: (doc, ids.astype(np.int64)), "doc_id bigint, ids array<bigint>", [pa.int64(), pa.list_(pa.int64())]).drop("start")
    return rows if seed is None else rows.orderBy(F.xxhash64(F.lit(seed), "shard", "record"), "shard", "record")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per record, from the files: doc_id, start (ids of all records before
    it), n_tokens, CRC-32 of its ids as unsigned 32-bit numbers."""
    util.ship(spark)
    index = read_index(spark, folder)
    rows = _taken(index, folder, F.col("record"), lambda doc, ids: (doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
                  "doc_id bigint, n_tokens bigint, ids_crc32 bigint", [pa.int64()] * 3)
    files = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = util.bounded(util.written(files.select("shard", before.alias("base"))))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Write ``docs`` as records, index the files, and read them back."""
    write_records(docs, path, folder)
    build_index(docs.sparkSession, folder)
    return digests(docs.sparkSession, folder)
