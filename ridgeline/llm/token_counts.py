"""Operator 2: token counts.

Arrow batches go through the tokenizer's batch call, which returns lengths
only.  Texts are cut at safe boundaries (``words``), so a very long text costs
no more memory than a short one; the distinct pieces of a batch are encoded in
calls balanced by bytes and remembered in a bounded table per worker.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm import util, words

#: Bytes of text handled together, and bytes given to one call of the tokenizer.
GROUP_BYTES, CALL_BYTES = 4_000_000, 250_000
OVER_LIMIT = 512
_STATE: dict[str, tuple] = {}

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def counter(path: str):
    """(batch of strings -> their token numbers) by the library for the file."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda batch: [len(x) for x in sp.encode(batch, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda batch: [len(x) for x in tok.encode_batch_fast(batch, add_special_tokens=False)]


def calls(strings: list[str], limit: int = CALL_BYTES) -> Iterator[list[str]]:
    """Runs of strings of about ``limit`` characters each."""
    run, size = [], 0
    for s in strings:
        run.append(s)
        size += len(s)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def groups(sizes: list[int], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def count_pieces(cut: list[list[str]], count, table: dict[str, int], limit: int = words.TABLE_LIMIT) -> list[int]:
    """Token number of each text, given as its pieces."""
    wanted = set().union(*cut)
    if len(table) + len(wanted) > limit:
        table.clear()
    for run in calls(sorted(wanted - table.keys(), key=len)):
        table.update(zip(run, count(run), strict=True))
    out = [sum(map(table.__getitem__, x)) for x in cut]
    for piece in wanted:
        if len(piece) > words.LONGEST:
            del table[piece]
    return out


def cut_text(text: str) -> list[str]:
    quick = words.parts(text)
    return words.pieces(text) if quick is None else quick[:1] + [" " + x for x in quick[1:]]


def token_counts(docs: DataFrame, path: str, over_limit: int = OVER_LIMIT, safe_cuts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty (0 tokens); a null doc_id stays null; repeated
    rows each give a row; other columns are ignored.  ``safe_cuts`` holds for
    byte-level vocabularies; sentencepiece models encode whole texts.
    """
    safe = safe_cuts and path.endswith(".json")

    def run(batches):
        count, table = _STATE.get(path) or _STATE.setdefault(path, (counter(path), {}))
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            sizes = pa.compute.binary_length(col).to_pylist()
            n_tokens: list[int] = []
            for a, b in groups(sizes):
                chunk = col.slice(a, b - a).to_pylist()
                n_tokens += count_pieces([cut_text(x) for x in chunk], count, table) if safe else [n for r in calls(chunk) for n in count(r)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > over_limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return util.texts(docs).mapInArrow(run, SCHEMA)
