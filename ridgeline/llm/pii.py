"""Operator 7 [native]: information-theoretic sanitisation of personal data.

Patterns find protected entities (mail and IP addresses, cards, phones).  Over
the whole corpus, a word's co-occurrence with an entity, that is, how often it
stands within a few words of it against how often it stands anywhere, gives
their pointwise mutual information.  A word whose information about an entity
comes near the entity's own information content discloses it; it is removed
wherever it occurs.  Words are white-space tokens without the punctuation around
them, in lower case; identifiers with digits or symbols inside count as words.

Everything is built-in functions.  Java's regular expressions match a pattern
with possessive quantifiers and a look-behind at its start, which takes linear
time and no recursion on long runs and gives the same matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import util

# The kinds and their patterns.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A text without these needs no search for the kind.
HINTS = (r"@", r"[0-9]\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){13}", r"\+[0-9]")
SPACE = r"[\x20\x09-\x0D]+"
#: Words on either side that co-occur with an entity.
NEAR = 3
#: Occurrences beside an entity that a word must have, and the share of the
#: entity's information content that it must disclose.
LEAST_TOGETHER, DISCLOSURE = 5, 0.9
#: What makes a token a word, and what of it is not part of the word.
WORD = r"[\p{L}\p{M}\p{N}]"
LEAD, TAIL = r"^[^\p{L}\p{M}\p{N}]++", r"(?<=[\p{L}\p{M}\p{N}])[^\p{L}\p{M}\p{N}]++$"
EDGE = f"{LEAD}|{TAIL}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.char_length(d)

    def worth(i: Column) -> Column:
        x = d.substr(n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i))
    return n.between(14, 19) & (F.when(n.between(14, 19), total).otherwise(1) % 10 == 0)


def _valid(kind: int, value: Column) -> Column:
    if kind == 1:
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == 2:
        return _luhn(value)
    if kind == 3:
        return F.char_length(_digits(value)).between(10, 15)
    return F.lit(True)


def _located(k: int) -> Column:
    """Matches m{k}, the texts between them g{k} and their words w{k} -> spans
    with the words near them, up to the next match of the kind."""
    here = f"a.p + char_length(g{k}[i])"
    near = (f"transform(concat(slice(w{k}[i], greatest(size(w{k}[i]) - {NEAR - 1}, 1), {NEAR}), slice(w{k}[i + 1], 1, {NEAR})),"
            f" w -> lower(regexp_replace(w, '{EDGE}', '')))").replace("\\", "\\\\")
    return F.expr(
        f"aggregate(sequence(0, size(m{k}) - 1), named_struct('p', 0, 'o', cast(array() as array<struct<start:int,kind:int,end:int,value:string,near:array<string>>>)),"
        f" (a, i) -> named_struct('p', {here} + char_length(m{k}[i]), 'o', concat(a.o, array(named_struct('start', {here}, 'kind', {k},"
        f" 'end', {here} + char_length(m{k}[i]), 'value', m{k}[i], 'near', {near})))), a -> a.o)")


def _kept(k: int) -> Column:
    return F.filter(_located(k), lambda s: _valid(k, s["value"]))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans (start, kind, end, value, near) of the base matches."""
    t = util.texts(docs)
    none = F.lit(None).cast("array<string>")
    for k, (pattern, hint) in enumerate(zip(PATTERNS, HINTS, strict=True)):
        t = t.withColumn(f"m{k}", F.when(F.col("text").rlike(hint), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    for k, pattern in enumerate(PATTERNS):
        t = t.withColumn(f"g{k}", F.when(F.size(f"m{k}") > 0, F.split("text", pattern)).otherwise(none))
    for k in range(len(PATTERNS)):
        t = t.withColumn(f"w{k}", F.when(F.size(f"m{k}") > 0, F.transform(f"g{k}", lambda g: F.filter(F.split(g, SPACE), lambda w: w.rlike(WORD)))))
    nothing = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string,near:array<string>>>)")
    for k in range(len(PATTERNS)):
        t = t.withColumn(f"s{k}", F.when(F.size(f"m{k}") > 0, _kept(k)).otherwise(nothing))
    return t.select("doc_id", "text", *[f"s{k}" for k in range(len(PATTERNS))], F.concat(*[f"s{k}" for k in range(len(PATTERNS))]).alias("spans"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _key() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64("text").alias("h")


def tokens(docs: DataFrame) -> DataFrame:
    """token, term (its word in lower case), n: white-space tokens that hold a word."""
    t = util.texts(docs).select(F.explode(words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.filter(F.col("token").rlike(WORD)).withColumn("term", F.lower(F.regexp_replace("token", EDGE, "")))


def disclosing(forms: DataFrame, base: DataFrame, least: int = LEAST_TOGETHER, share: float = DISCLOSURE) -> DataFrame:
    """term, bits: words that disclose some entity.  ``forms`` are the
    ``tokens``; ``base`` has the entity spans of all rows with the words near
    them, and n_words."""
    entity = F.explode("spans")
    spans = base.select(entity.alias("s")).select(F.xxhash64(F.col("s.kind"), F.col("s.value")).alias("entity"), F.col("s.near").alias("near"))
    n_entity = spans.groupBy("entity").agg(F.count("*").alias("n_entity"))
    together = (spans.select("entity", F.explode(F.array_distinct("near")).alias("term"))
                .groupBy("entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= least))
    n_term = forms.groupBy("term").agg(F.sum("n").alias("n_term")).filter(F.col("n_term") >= least)
    n = base.agg(F.sum("n_words")).first()[0] or 0
    pmi = F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_term") * F.col("n_entity")))
    content = F.log2(F.lit(float(n)) / F.col("n_entity"))
    return (together.join(n_entity, "entity").join(n_term, "term").withColumn("bits", pmi)
            .filter(F.col("bits") >= share * content).groupBy("term").agg(F.max("bits").alias("bits")))


def _term_spans(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """doc_id, h, terms (start, kind, end): where the words of the tokens ``forms`` stand."""
    keyed = util.texts(docs).select("doc_id", _key(), "text")
    hits = util.written(keyed.select("doc_id", "h", F.explode(F.array_distinct(words(F.col("text")))).alias("token")).join(forms.select("token"), "token")
                        .distinct().groupBy("doc_id", "h").agg(F.collect_list("token").alias("found")))
    same = hits.select(F.col("doc_id").alias("id"), F.col("h").alias("k"), "found")
    rows = keyed.join(same, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("k"))).dropDuplicates(["id", "k"])
    quoted = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])\Q"), F.replace("token", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![^\x20\x09-\x0D])"))
    one = rows.select("doc_id", "h", "text", F.explode("found").alias("token")).select(
        "doc_id", "h", F.char_length("token").alias("n"), F.char_length(F.regexp_replace("token", TAIL, "")).alias("stop"),
        (F.char_length("token") - F.char_length(F.regexp_replace("token", LEAD, ""))).alias("lead"), F.split("text", quoted, -1).alias("g"))
    where = F.expr("aggregate(sequence(0, size(g) - 2), named_struct('p', 0, 'o', cast(array() as array<struct<start:int,kind:int,end:int>>)),"
                   " (a, i) -> named_struct('p', a.p + char_length(g[i]) + n, 'o', concat(a.o, array(named_struct("
                   f"'start', a.p + char_length(g[i]) + lead, 'kind', {len(KINDS) - 1}, 'end', a.p + char_length(g[i]) + stop)))), a -> a.o)")
    return one.filter("size(g) > 1").select("doc_id", "h", where.alias("t")).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("t")).alias("terms"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _bare(spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, least: int = LEAST_TOGETHER, share: float = DISCLOSURE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, the
    digest of the base spans, and all spans, disclosing terms outside of
    entities included (a term may overlap the end of an entity).
    Offsets are code points.  Null texts count as empty (no spans); a null
    doc_id stays null; repeated rows get the same spans; other columns are
    ignored; an empty table gives no rows."""
    f = found(docs)
    base = util.written(f.select("doc_id", _key(), *[F.size(f"s{k}").cast("bigint").alias(f"n_{KINDS[k]}") for k in range(4)],
                                 F.size(words(F.col("text"))).cast("bigint").alias("n_words"), "spans"))
    forms = util.written(tokens(docs))
    terms = util.written(disclosing(forms, base, least, share))
    where = _term_spans(docs, util.written(forms.join(terms, "term").select("token"))).withColumnsRenamed({"doc_id": "id", "h": "k"})
    bare = base.withColumn("base", _bare("spans"))
    both = bare.join(where, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("k")), "left")
    outside = F.filter("terms", lambda t: ~F.exists("base", lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"])))
    every = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat("base", outside))
    return both.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))


def sanitise(text: Column, spans: Column) -> Column:
    """``text`` with each span of ``scan`` (as its string) replaced: entities by
    their kind in brackets, disclosing terms by [...].  Of overlapping spans
    each covers what is left."""
    parts = F.filter(F.split(spans, ","), lambda s: s != "")
    start = lambda s: F.split(s, ":")[1].cast("int")
    end = lambda s: F.split(s, ":")[2].cast("int")
    mark = lambda s: F.when(F.split(s, ":")[0] == "term", F.lit("[...]")).otherwise(F.concat(F.lit("["), F.upper(F.split(s, ":")[0]), F.lit("]")))
    out = F.aggregate(
        parts, F.struct(F.lit(0).alias("p"), F.lit("").alias("o")),
        lambda a, s: F.when(end(s) > a["p"], F.struct(
            end(s).alias("p"),
            F.concat(a["o"], text.substr(a["p"] + 1, F.greatest(start(s) - a["p"], F.lit(0))), mark(s)).alias("o")))
        .otherwise(a), lambda a: F.concat(a["o"], text.substr(a["p"] + 1, F.char_length(text))))
    return F.when(F.size(parts) > 0, out).otherwise(text)
