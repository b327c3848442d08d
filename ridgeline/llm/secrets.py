"""Operator 5: secrets by patterns and a linear-chain conditional random field.

Patterns find the base spans.  A CRF, trained on the surroundings of base spans
in a bounded sample, tags white-space tokens as secret begin, inside or outside
from their shape, length and mix of characters, the words beside them, and
features of the whole text; Viterbi decodes it.  Tagged spans that touch no
base span are added.

Most tokens cannot be part of a secret whatever stands beside them: where the
outside score leads by more than two transitions can make up for, every best
path is outside.  Viterbi runs on the stretches between such tokens, which
gives the same path as one run over the whole text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import util, words

# The base patterns, and what a match must have besides.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 or more; leftmost matches of + that are long enough
KINDS = ("assign", "access", "hex", "crf")
KEYWORD = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")

#: Sampled texts that hold a base pattern, and others; windows taken from one
#: text; tokens on either side of a window's middle.
SAMPLE_HITS, SAMPLE_PLAIN, WINDOWS, SIDE = 400, 200, 2, 8
#: Neighbouring words that are features by themselves; training passes, their step, ridge weight.
CONTEXT_WORDS, PASSES, RATE, RIDGE = 60, 120, 0.2, 1e-5
#: Characters that don't count at the ends of a tagged span; the shortest span added.
TRIM, SHORTEST = "\"'`.,;:!?#*$%&()[]{}<>|=", 8
O, B, I = 0, 1, 2
_TOKEN = re.compile(r"\S+")
_TABLES: dict[str, words.Table] = {}

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def base_spans(text: str, keyword: bool = True, access: bool = True, hexa: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches; a False skips a kind known to be absent."""
    out = []
    if keyword:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if access:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if hexa:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class _Classes(dict):
    """Code point -> x, X, D or -, for str.translate."""

    def __missing__(self, code):
        c = chr(code)
        self[code] = kind = ("X" if c.isupper() else "x") if c.isalpha() else "D" if c.isdigit() else "-"
        return kind


_CLASSES, _RUN = _Classes(), re.compile(r"(.)\1+")


def has_keyword(token: str) -> bool:
    low = token.lower()
    return ("pass" in low or "secret" in low or "token" in low or "api" in low) and KEYWORD.search(token) is not None


def own_features(token: str) -> tuple[str, ...]:
    """Size, the first runs of upper case, lower case, digits and others, the
    variety of characters, the share of digits; what else is striking."""
    bare = token.strip(TRIM)
    n = len(bare)
    kinds = bare.translate(_CLASSES)
    digits = kinds.count("D")
    out = ["bias", f"size={min(6, n.bit_length())}", f"shape={_RUN.sub(r'\1', kinds)[:6]}", f"variety={min(5, len(set(bare)) // 4)}",
           f"digits={1 + int(3.99 * digits / n) if digits else 0}"]
    if not bare.isascii():
        out.append("foreign")
    elif digits and n >= 8:
        if "x" in kinds and "X" in kinds[1:]:
            out.append("mixed")
        if re.fullmatch(r"[0-9a-fA-F]+", bare):
            out.append("hexadecimal")
    if has_keyword(token):
        out.append("keyword")
    return tuple(out)


def lead(s: np.ndarray) -> float:
    return float(max(s[B], s[I]) - s[O])


@dataclass
class Crf:
    index: dict[str, int]
    weights: np.ndarray  # features x tags
    moves: np.ndarray  # from tag x to tag
    context: frozenset
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    sums: dict = field(default_factory=dict)  # of the own features met so far
    plain: dict = field(default_factory=dict)  # (size, variety, capital) of a plain word -> outside whatever stands beside it?

    def beside(self, token: str) -> list[str]:
        """What a token tells its neighbours; nothing for most."""
        out = []
        bare = token.strip(TRIM).lower()
        if has_keyword(token):
            out.append("keyword")
        if token[-1] in "=:" or bare in ("is", "="):
            out.append("sets")
        if bare in self.context:
            out.append(f"word={bare}")
        return out

    def sum(self, names) -> np.ndarray:
        rows = [self.index[x] for x in names if x in self.index]
        return self.weights[rows].sum(0) if rows else np.zeros(3)

    def __post_init__(self):
        file = [self.sum([f]) for f in ("file:keyword", "file:dense")]
        #: The most that two transitions and the features of a text can make up for.
        self.reach = 2 * float(self.moves.max() - self.moves.min()) + sum(max(0.0, lead(w)) for w in file)

    def own(self, token: str) -> tuple[np.ndarray, float]:
        """(scores of the token's own features, the lead over outside)"""
        names = own_features(token)
        got = self.sums.get(names)
        if got is None:
            s = self.sum(names)
            got = self.sums[names] = s, lead(s)
        return got

    def facts(self, token: str):
        """A token's own scores, those for its neighbours (next, the one after,
        the one before), each with its lead over outside; which patterns it may
        belong to; and which tokens, as offsets, it may bring into a secret.
        None if it tells its neighbours nothing and is outside in every best
        path."""
        bare = token.strip(TRIM)
        if len(token) < 32 and bare.isalpha() and bare.isascii() and bare[1:].islower():  # most tokens: one word
            word = bare.lower()
            if word != "is" and word not in self.context and token[-1] not in "=:" and not ("pass" in word or "secret" in word or "token" in word or "api" in word):
                key = (len(bare), len(set(bare)) // 4, bare[0].isupper())
                outside = self.plain.get(key)
                if outside is None:
                    outside = self.plain[key] = self.own(token)[1] + self.reach < 0
                if outside:
                    return None
        own, near = self.own(token), self.beside(token)
        flags = (has_keyword(token), "AKIA" in token, len(token) >= 32 and HEX.search(token) is not None)
        if not near and not any(flags) and own[1] + self.reach < 0:
            return None
        told = [self.sum([f"{at}:{x}" for x in near]) for at in ("prev", "prev2", "next")]
        told = [(s, max(0.0, lead(s))) for s in told]
        wakes = [0] * (own[1] + self.reach >= 0) + [at for at, (_, more) in zip((1, 2, -1), told, strict=True) if more > 0]
        return own, *told, flags, wakes

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi between two outside tokens."""
        best, back = scores[0] + self.moves[O], []
        for s in scores[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(0))
            best = ways.max(0) + s
        tags = [int((best + self.moves[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, added spans), each (start, kind, end)."""
        tables = _TABLES.get(self.name)
        if tables is None:
            _TABLES.clear()
            tables = _TABLES[self.name] = words.Table(self.facts, 500_000), words.Table(self.own, 300_000)
        table, own = tables
        tokens = text.split()
        got = [*map(table.__getitem__, tokens)]
        odd = [i for i, x in enumerate(got) if x is not None]
        if not odd:
            return [], []
        flags = [any(got[i][4][k] for i in odd) for k in range(3)]
        base = base_spans(text, *flags)
        file = self.sum(file_features(tokens, len(odd), flags[0]))
        ahead, n = lead(file) + 2 * float(self.moves.max() - self.moves.min()), len(tokens)
        open_at: list[tuple[int, np.ndarray]] = []
        for j in sorted({i + at for i in odd for at in got[i][5]}):
            if not 0 <= j < n:
                continue
            x = [got[j][0] if got[j] else own[tokens[j]]]
            x += [got[k][at] for k, at in ((j - 1, 1), (j - 2, 2), (j + 1, 3)) if 0 <= k < n and got[k]]
            if sum([y[1] for y in x]) + ahead >= 0:
                open_at.append((j, file + sum([y[0] for y in x])))
        tagged: list[tuple[int, int]] = []  # first and last token of a secret
        i = 0
        while i < len(open_at):
            k = i
            while k + 1 < len(open_at) and open_at[k + 1][0] == open_at[k][0] + 1:
                k += 1
            for (j, _), tag in zip(open_at[i: k + 1], self.decode(np.array([s for _, s in open_at[i: k + 1]])), strict=True):
                if tag == I and tagged and tagged[-1][1] == j - 1:
                    tagged[-1] = (tagged[-1][0], j)
                elif tag != O:
                    tagged.append((j, j))
            i = k + 1
        return base, added(text, base, tagged) if tagged else []


def file_features(tokens: list[str], n_odd: int, keyword: bool) -> list[str]:
    return ["file:keyword"] * keyword + ["file:dense"] * (n_odd * 20 > len(tokens))


def added(text: str, base: list[tuple[int, int, int]], tagged: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    at = [m.span() for m in _TOKEN.finditer(text)]
    out = []
    for first, last in tagged:
        start, end = at[first][0], at[last][1]
        while start < end and text[start] in TRIM:
            start += 1
        while end > start and text[end - 1] in TRIM:
            end -= 1
        if end - start >= SHORTEST and not any(s < end and start < e for s, _, e in base):
            out.append((start, 3, end))
    return out


def windows(text: str) -> list[list[tuple[str, int]]]:
    """Training pieces of a text: (token, tag) around base spans, and the start of the text."""
    at = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + [(s, e) for s, k, e in base_spans(text, keyword=False)]
    tags = [O] * len(at)
    for s, e in values:
        inside = [i for i, (_, a, b) in enumerate(at) if a < e and s < b]
        for n, i in enumerate(inside):
            tags[i] = B if not n else I
    middles = [i for i, t in enumerate(tags) if t == B][:WINDOWS] + [min(SIDE, len(at) // 2), len(at) // 2]
    return [[(at[i][0], tags[i]) for i in range(max(0, m - SIDE), min(len(at), m + SIDE + 1))] for m in middles] if at else []


def train(pieces: list[list[tuple[str, int]]]) -> Crf:
    """CRF by gradient steps on the regularised likelihood of the windows;
    without any, one that tags everything as outside."""
    if not pieces:
        return Crf({}, np.zeros((0, 3)), np.array([[0.0, -1, -1], [0, -1, -1], [0, -1, -1]]), frozenset())
    before = Counter(w[i - 1][0].strip(TRIM).lower() for w in pieces for i in range(1, len(w)) if w[i][1] == B)
    crf = Crf({}, np.zeros((0, 3)), np.zeros((3, 3)), frozenset(x for x, _ in before.most_common(CONTEXT_WORDS) if x))
    length = 2 * SIDE + 1
    rows: list[list[str]] = []
    tag, mask = np.zeros((len(pieces), length), int), np.zeros((len(pieces), length), bool)
    for n, w in enumerate(pieces):
        tokens = [x for x, _ in w]
        near = [crf.beside(x) for x in tokens]
        odd = sum(map(bool, near))
        file = file_features(tokens, odd, any("keyword" in x for x in near))
        for i, (x, y) in enumerate(w):
            tag[n, i], mask[n, i] = y, True
            rows.append([*own_features(x), *file] + [f"{at}:{f}" for k, at in ((i + 1, "next"), (i - 1, "prev"), (i - 2, "prev2")) if 0 <= k < len(w) for f in near[k]])
    seen = Counter(f for r in rows for f in r)
    crf.index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= 3))}
    x = np.zeros((len(rows), len(crf.index)))
    for i, r in enumerate(rows):
        x[i, [crf.index[f] for f in r if f in crf.index]] = 1
    flat = np.flatnonzero(mask)
    theta = np.zeros((len(crf.index) + 3, 3))  # weights, then transitions
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros((mask.size, 3))
    gold[flat, tag.ravel()[flat]] = 1
    wide = np.concatenate([np.zeros((len(pieces), 1), int), np.where(mask, tag, O), np.zeros((len(pieces), 1), int)], 1)
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (wide[:, :-1].ravel(), wide[:, 1:].ravel()), 1)
    for step in range(1, PASSES + 1):
        w, t = theta[:-3], theta[-3:]
        s = np.zeros((mask.size, 3))
        s[:] = [0, -1e3, -1e3]  # beyond a window all is outside
        s[flat] = x @ w
        p, moved = marginals(s.reshape(len(pieces), length, 3), t)
        slope = np.concatenate([x.T @ (gold - p.reshape(-1, 3))[flat], gold_moves - moved]) / len(pieces) - RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2  # Adam
        theta = theta + RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Crf(crf.index, theta[:-3], theta[-3:], crf.context)


def marginals(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag marginals and expected transitions; outside before and after."""
    def total(a, axis):
        top = a.max(axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)
    n, length, _ = s.shape
    fore, back = np.empty_like(s), np.empty_like(s)
    fore[:, 0] = s[:, 0] + t[O]
    for i in range(1, length):
        fore[:, i] = s[:, i] + total(fore[:, i - 1, :, None] + t, 1)
    back[:, -1] = t[:, O]
    for i in range(length - 2, -1, -1):
        back[:, i] = total(t + (s[:, i + 1] + back[:, i + 1])[:, None, :], 2)
    z = total(fore[:, -1] + t[:, O], 1)[:, None]
    p = np.exp(fore + back - z[:, :, None])
    moved = np.exp(fore[:, :-1, :, None] + t + (s + back)[:, 1:, None, :] - z[:, :, None, None]).sum((0, 1))
    moved[O] += p[:, 0].sum(0)
    moved[:, O] += p[:, -1].sum(0)
    return p, moved


def fit(docs: DataFrame) -> Crf:
    """CRF from windows of a bounded sample of different rows (smallest hashes
    of doc_id, then of the text): ``SAMPLE_HITS`` that hold a base pattern, and
    ``SAMPLE_PLAIN`` others.  The patterns are sought among the smallest hashes
    first, and among more of them until there are enough, which finds the same
    rows as a search of all.  Rows that share a doc_id, or have none, count by
    their texts; repeated rows count once; without rows nothing is tagged."""
    loose = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
    t = util.texts(docs).select("text", F.xxhash64("doc_id").alias("h"))
    total, share = docs.count(), 0.0
    while True:
        share = min(1.0, max(8 * share, 16 * SAMPLE_HITS / max(1, total)))
        near = t.filter(F.col("h") <= int((share - 0.5) * 2 ** 64) if share < 1 else F.lit(True))
        near = near.withColumn("th", F.xxhash64("text"))
        first = lambda rows, n: rows.select("h", "th").distinct().orderBy("h", "th").limit(n).collect()
        hits = first(near.filter(F.col("text").rlike(loose)), SAMPLE_HITS)
        if len(hits) == SAMPLE_HITS or share == 1:
            break
    chosen = sorted({(r["h"], r["th"]) for r in hits + first(near, SAMPLE_PLAIN)})

    def run(batches):
        for b in batches:
            got = [w for x in b.column(0).to_pylist() for w in windows(x)]
            yield pa.RecordBatch.from_arrays([pa.array([[x for x, _ in w] for w in got], pa.list_(pa.string())), pa.array([[y for _, y in w] for w in got], pa.list_(pa.int32()))], ["tokens", "tags"])

    keys = docs.sparkSession.createDataFrame(chosen, "h bigint, th bigint")
    rows = (near.join(F.broadcast(keys), ["h", "th"], "left_semi").select("text")
            .mapInArrow(run, "tokens array<string>, tags array<int>").distinct().orderBy("tokens", "tags").collect())
    return train([list(zip(r.tokens, r.tags, strict=True)) for r in rows])


def scan(docs: DataFrame, crf: Crf) -> DataFrame:
    """One row per row of ``docs``: doc_id, number of base spans by kind,
    digest of the base spans, all spans.  Offsets are code points.  Null texts
    count as empty (no spans); a null doc_id stays null; repeated rows each
    give a row; an empty table gives none; other columns are ignored."""
    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for x in b.column(1).to_pylist():
                base, more = crf.scan(x)
                text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                out.append((*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(text.encode()).hexdigest(),
                            ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + more)) if more else text))
            cols = [*zip(*out, strict=True)] if out else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return util.texts(docs).mapInArrow(run, SCHEMA)


def redact(text: str, crf: Crf, mark: str = "[SECRET]") -> str:
    """The text with every span, base or added, replaced by ``mark``."""
    base, more = crf.scan(text)
    out, at = [], 0
    for s, _, e in sorted(base + more):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(text: Column, crf: Crf, mark: str = "[SECRET]") -> Column:
    """A text column without its secrets; null stays null."""
    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: redact(x, crf, mark), na_action="ignore")
    return cover(text)
