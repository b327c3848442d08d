"""Operator 12: repair of the structure of conversations.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles.  Edits
keep, rerole or delete a row, or insert an empty one; a dynamic program finds
the least cost, and prefix doubling the least of the cheapest audits (the
edits' initials in order): the nodes of the optimal arcs, each a row and a
state of the pattern, are ranked by the first, the first two, four, eight, ...
letters that can follow them, while pointers double over as many arcs; the arc
with the least letter and target rank is taken, and the path is read through
the doubled pointers, all its places at once.  From a node every letter leads
to one other node, so the least letters name one path.

Rows are sorted by ranges and cut into chunks of bounded size, so a
conversation may hold any share of them.  One that spans chunks is joined by
doubling too: each of its chunks is a (min, +) matrix over the states, products
of 1, 2, 4, ... chunks give the cost from every chunk to the end, and
compositions of the chunks' maps the state in which each is entered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import util

# Costs of the edits; keeping or reroling a truncated row costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Faults, by precedence.
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Rows of a chunk: 2 to this power.
CHUNK_BITS = 12
_SPACE = r"\x20\x09-\x0D"
_FAR = 1 << 50
#: States: nothing yet, after s, after u, after a.  Where u or a leads to from each, and what role that is.
_STATES, _NEXT, _ROLE = 4, (2, 2, 3, 2), ("", "s", "u", "a")
_END = (0, 2 * INSERT, INSERT, 0)
#: Audit letters in their order; 0 stands for the end.
_LETTERS = np.array(["", "D", "I", "K", "R"])
_D, _I, _K, _R = 1, 2, 3, 4

PATHS = "conv string, g bigint, entry int, exit int, cost bigint, illegal bigint, audit string, roles string, ats array<bigint>"


def kept_state(state: int, initial: str) -> int | None:
    """The state after keeping a row of this initial, None if it doesn't fit."""
    if initial == "s":
        return 1 if state == 0 else None
    return _NEXT[state] if initial and initial == _ROLE[_NEXT[state]] else None


def _options(initial: str, fault: int) -> list[list[tuple[int, int, int]]]:
    """By state: (letter, cost, state after) of the edits that take up a row."""
    more, out = TRUNCATED if fault == CUT else 0, []
    for s in range(_STATES):
        ways = [(_D, DELETE, s)]
        if fault not in (BLANK, DUPLICATE):
            ways.append((_R, REROLE + more, _NEXT[s]))
            if (kept := kept_state(s, initial)) is not None:
                ways.append((_K, more, kept))
        out.append(ways)
    return out


_WAYS = {(i, f): _options(i, f) for i in ("s", "u", "a", "x") for f in range(4)}


def costs(rows: list[tuple[str, int]], end) -> list[list[int]]:
    """Cost to the end from every (row, state); ``end``: costs after the last row."""
    out = [list(end)]
    for row in reversed(rows):
        later = out[-1]
        now = [min(c + later[t] for _, c, t in ways) for ways in _WAYS[row]]
        now[2], now[3] = min(now[2], INSERT + now[3]), min(now[3], INSERT + now[2])
        now[0], now[1] = min(now[0], INSERT + now[2]), min(now[1], INSERT + now[2])
        out.append(now)
    return out[::-1]


def least_paths(units: list[tuple[list[tuple[str, int]], list[int], bool, list[int]]]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For units (rows, costs after them, whether the conversation ends there,
    entry states): for each entry, the cost, and the letters and nodes (as
    4 * row + state) of the least of the cheapest paths."""
    source, target, letter, starts, bases, total = [], [], [], [], [], 0
    for rows, end, last, entries in units:
        h = costs(rows, end)
        for i, row in enumerate(rows):
            at = total + _STATES * i
            for s, ways in enumerate(_WAYS[row]):
                for name, c, t in ways:
                    if c + h[i + 1][t] == h[i][s]:
                        source.append(at + s), target.append(at + _STATES + t), letter.append(name)
                if INSERT + h[i][_NEXT[s]] == h[i][s]:
                    source.append(at + s), target.append(at + _NEXT[s]), letter.append(_I)
        if last:
            at = total + _STATES * len(rows)
            source += [at + 1, at + 2]
            target += [at + 2, at + 3]
            letter += [_I, _I]
        bases.append(total)
        starts += [(total + e, h[0][e]) for e in entries]
        total += _STATES * (len(rows) + 1)
    source, target, letter = np.array(source, np.int64), np.array(target, np.int64), np.array(letter, np.int64)

    def chosen(rank: np.ndarray):
        """The arc of each node with the least letter, then the least target."""
        order = np.lexsort((rank[target], letter, source))
        first = order[np.unique(source[order], return_index=True)[1]] if len(order) else order
        step, name = np.arange(total), np.zeros(total, np.int64)  # an end points to itself
        step[source[first]], name[source[first]] = target[first], letter[first]
        return step, name

    step, rank = chosen(np.zeros(total, np.int64))
    while rank[step].any():  # ranks by the first 2, 4, 8, ... letters; 0 is the end
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[step], return_inverse=True)[1]
        step = step[step]
    step, name = chosen(rank)

    steps, length = [step], (name > 0).astype(np.int64)
    while True:  # pointers over 1, 2, 4, ... arcs and the letters on them
        onward = length[steps[-1]]
        if not onward.any():
            break
        length = length + onward
        steps.append(steps[-1][steps[-1]])
    first = np.array([s for s, _ in starts], np.int64)
    n = length[first]
    at = np.repeat(first, n)
    place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    for k, pointer in enumerate(steps):
        far = (place >> k & 1).astype(bool)
        at[far] = pointer[at[far]]
    out, i, j = [], 0, 0
    for (_, _, _, entries), base in zip(units, bases, strict=True):
        out.append([])
        for _ in entries:
            nodes = at[i:i + n[j]]
            ends = step[nodes[-1]] if len(nodes) else first[j]
            out[-1].append((starts[j][1], name[nodes], np.append(nodes, ends) - base))
            i, j = i + int(n[j]), j + 1
    return out


def illegal_pairs(initials: str) -> int:
    return sum(x not in ("su", "ua", "au") for x in map("".join, zip(initials, initials[1:], strict=False)))


def _chunk_paths(frame: pd.DataFrame) -> pd.DataFrame:
    """Least paths of the conversations, or parts of them, in one chunk."""
    frame = frame.sort_values("at", kind="stable")
    units, names, ats = [], [], []
    for conv, part in frame.groupby("conv", sort=False):
        one = part.iloc[0]
        rows = list(zip(part["initial"], part["fault"], strict=True))
        end = _END if one["ends"] is None else [int(x) for x in one["ends"]]
        units.append((rows, end, one["ends"] is None, [0] if one["first"] else list(range(_STATES))))
        names.append(conv)
        ats.append(part["at"].to_numpy(np.int64))
    out = []
    for conv, at, unit, found in zip(names, ats, units, least_paths(units), strict=True):
        wrong = illegal_pairs("".join(i for i, _ in unit[0]))
        at = np.append(at, -1)
        for entry, (cost, letters, nodes) in zip(unit[3], found, strict=True):
            before, after = nodes[:-1], nodes[1:]
            roles = "".join("-" if x == _D else _ROLE[s] for x, s in zip(letters, after % _STATES, strict=True))
            out.append((conv, int(frame["g"].iloc[0]), entry, int(nodes[-1] % _STATES), cost, wrong, "".join(_LETTERS[letters]), roles,
                        np.where(letters == _I, -1, at[before // _STATES])))
    return pd.DataFrame(out, columns=[x.split()[0] for x in PATHS.split(", ")])


def _chunk_matrix(frame: pd.DataFrame) -> pd.DataFrame:
    """Part of a conversation as a (min, +) matrix, and its outer initials."""
    frame = frame.sort_values("at", kind="stable")
    rows = list(zip(frame["initial"], frame["fault"], strict=True))
    columns = [costs(rows, [0 if s == t else _FAR for s in range(_STATES)])[0] for t in range(_STATES)]
    m = [min(columns[t][s], _FAR) for s in range(_STATES) for t in range(_STATES)]
    return pd.DataFrame([(frame["conv"].iloc[0], int(frame["g"].iloc[0]), rows[0][0], rows[-1][0], m)], columns=["conv", "g", "opens", "closes", "m"])


def _times(x: str, y: str) -> Column:
    """(min, +) product of two 4 x 4 matrices held as arrays of 16."""
    return F.expr(f"transform(sequence(0, 15), i -> least({_FAR}L, array_min(transform(sequence(0, 3), k -> {x}[i div 4 * 4 + k] + {y}[k * 4 + i % 4]))))")


def _doubled(parts: DataFrame, column: str, back: bool, joined: Column) -> DataFrame:
    """``parts`` (conv, g, column) with each value combined over all parts of
    its conversation that follow (or precede) it, in log2 of their number of
    rounds.  ``joined`` combines ``x``, a value so far, and ``y``, the one
    next to what x covers."""
    span = parts.groupBy("conv").agg((F.max("g") - F.min("g")).alias("n")).agg(F.max("n")).first()[0] or 0
    now, reach = parts.select("conv", "g", F.col(column).alias("x")), 1
    while reach <= span:
        other = now.select("conv", (F.col("g") + (reach if back else -reach)).alias("g"), F.col("x").alias("y"))
        now = util.written(now.join(other, ["conv", "g"], "left").select("conv", "g", F.when(F.col("y").isNull(), F.col("x")).otherwise(joined).alias("x")))
        reach *= 2
    return now


def _entered(paths: DataFrame) -> DataFrame:
    """(conv, g, entry): the state in which each part is entered."""
    exits = F.sort_array(F.collect_list(F.struct("entry", "exit"))).alias("e")  # four at most
    maps = paths.groupBy("conv", "g").agg(exits).select("conv", "g", F.expr("transform(sequence(0, 3), s -> if(size(e) = 1, e[0].exit, e[s].exit))").alias("x"))
    after = _doubled(util.written(maps), "x", True, F.expr("transform(y, s -> x[s])"))
    return after.select("conv", (F.col("g") + 1).alias("g"), F.col("x")[0].alias("entry"))


def _key(conv: Column) -> Column:
    return F.coalesce(conv.cast("string"), F.lit(" "))


def _placed(rows: DataFrame) -> DataFrame:
    """Written table of the rows in order (``at``), with digests of the texts."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest"), F.col("row")]
    # Row numbers only split equal rows over ranges; they decide nothing.
    t = rows.select(_key(rows["conv_id"]).alias("conv"), rows["turn"].cast("bigint").alias("turn"),
                    *[F.coalesce(rows[c].cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    t = t.select("*", F.substring("text", 1, 64).alias("head"), F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    return util.written(t.select("conv", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("at")))


def _faulty(placed: DataFrame) -> DataFrame:
    """Written table (conv, turn, at, initial, fault, g); g numbers the chunks without gaps."""
    first = placed.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("seen"))
    letter = F.substring("role", 1, 1)
    fault = (F.when(~F.col("text").rlike(f"[^{_SPACE}]"), BLANK).when(F.col("seen").isNull(), DUPLICATE)
             .when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), CUT).otherwise(0).alias("fault"))
    part = F.shiftright("at", 33)
    chunks = placed.groupBy(part.alias("part")).agg(F.max(F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("last")).collect()  # a row per range
    base, sizes = 0, []
    for r in sorted(chunks):
        sizes.append((r["part"], base))
        base += (r["last"] >> CHUNK_BITS) + 1
    bases = placed.sparkSession.createDataFrame(sizes, "part bigint, base bigint")
    narrow = placed.join(first, "at", "left").select("conv", "turn", "at", F.when(letter.isin("s", "u", "a"), letter).otherwise("x").alias("initial"), fault, part.alias("part"))
    g = F.col("base") + F.shiftright(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), CHUNK_BITS)
    return util.written(narrow.join(F.broadcast(bases), "part").withColumn("g", g).drop("part", "base"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair conversations (conv_id, turn, role, text).

    Returns (reports, repaired).  Reports, one row per conversation: conv (its
    id as a string), gaps, blank, duplicate, truncated, illegal, cost, audit.
    Repaired rows: conv, g, pos (their order), edit (K, R or I), role, text.

    Null roles and texts count as one space, and so does a null conv_id, which
    is a conversation by itself; null turns come first.  Rows of one turn are
    taken by role, then text (its first 64 characters, then its digest); fully
    repeated rows are duplicates; other columns are ignored; no rows give empty
    tables.
    """
    util.ship(rows.sparkSession)
    placed = _placed(rows)
    narrow = _faulty(placed)
    count = lambda f: F.sum((F.col("fault") == f).cast("bigint"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    spans = util.written(narrow.groupBy("conv").agg(
        F.min("g").alias("first_g"), F.max("g").alias("last_g"), gaps.alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(CUT).alias("truncated")))

    long = util.written(spans.filter("first_g < last_g").select("conv", "first_g", "last_g"))
    parts = util.written(narrow.join(util.bounded(long.select("conv")), "conv").groupBy("conv", "g").applyInPandas(_chunk_matrix, "conv string, g bigint, opens string, closes string, m array<bigint>"))
    rest = _doubled(parts, "m", False, _times("x", "y"))
    end = ", ".join(map(str, _END))
    to_end = F.expr(f"transform(sequence(0, 3), s -> array_min(transform(sequence(0, 3), k -> x[s * 4 + k] + array({end})[k])))")
    follow = rest.select("conv", (F.col("g") - 1).alias("g"), to_end.alias("ends"))  # what follows part g
    ends = util.bounded(util.written(follow))
    paths = util.written(narrow.join(ends, ["conv", "g"], "left").join(util.bounded(long), "conv", "left")
                         .select("conv", "g", "at", "initial", "fault", "ends", F.coalesce(F.col("g") == F.col("first_g"), F.lit(True)).alias("first"))
                         .groupBy("g").applyInPandas(_chunk_paths, PATHS))
    entered = util.bounded(util.written(_entered(paths.join(util.bounded(long.select("conv")), "conv")).withColumnRenamed("entry", "way")))
    taken = util.written(paths.join(entered, ["conv", "g"], "left").filter(F.col("entry") == F.coalesce("way", F.lit(0))).drop("way"))

    outer = parts.select("conv", "g", "closes").join(parts.select("conv", (F.col("g") - 1).alias("g"), "opens"), ["conv", "g"])
    between = outer.groupBy("conv").agg(F.sum((~F.concat("closes", "opens").isin("su", "ua", "au")).cast("bigint")).alias("between"))
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "audit"))), lambda x: x["audit"]), "")
    whole = taken.groupBy("conv").agg(F.min_by("cost", "g").alias("cost"), F.sum("illegal").alias("illegal"), audit.alias("audit"))
    reports = (spans.join(whole, "conv").join(between, "conv", "left")
               .select("conv", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("between", F.lit(0))).alias("illegal"), "cost", "audit"))

    edits = taken.select("conv", "g", "audit", "roles", F.posexplode("ats").alias("pos", "at"))
    named = F.when(F.col("roles") == "u", "user").otherwise("assistant")
    edits = edits.select("conv", "g", "pos", "at", *[F.expr(f"substring({c}, pos + 1, 1)").alias(c) for c in ("audit", "roles")])
    texts = placed.select("at", F.col("role").alias("own"), "text")
    kept = edits.filter(F.col("audit").isin("K", "R")).join(texts, "at")
    columns = ["conv", "g", "pos", F.col("audit").alias("edit")]
    repaired = kept.select(*columns, F.when(F.col("audit") == "K", F.col("own")).otherwise(named).alias("role"), "text").unionByName(
        edits.filter("audit = 'I'").select(*columns, named.alias("role"), F.lit("").alias("text")))
    return reports, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the lines ``role:text``, joined by line
    feeds.  A conversation's digest runs over its sorted rows in turn, so one
    of any length needs no more than a batch of memory."""
    def run(batches):
        conv, digest = None, None
        for b in batches:
            done: list[tuple[str, str]] = []
            for c, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if c != conv:
                    if conv is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["conv", "repaired_sha256"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    lines = repaired.select("conv", F.concat_ws(":", "role", "text").alias("line"), "g", "pos")
    return lines.repartition("conv").sortWithinPartitions("conv", "g", "pos").select("conv", "line").mapInArrow(run, "conv string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults put in by the CRC-32 of
    'conv_id:turn' modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    marks .!? away, 3 repeats it, 4 makes it the user's.  Nulls read as one space."""
    spaced = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    t = rows.select(rows["conv_id"].alias("conv_id"), rows["turn"].alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return t.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("copy")


def damage_report(rows: DataFrame) -> DataFrame:
    """Damage ``rows``, repair them, and report on every conversation: conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Without rows after the damage: zeros, no audit, the digest of no text."""
    reports, repaired = repair(damage(rows))
    ids = rows.groupBy(_key(rows["conv_id"]).alias("conv")).agg(F.min("conv_id").alias("conv_id"))
    out = ids.join(reports, "conv", "left").join(digests(repaired), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
