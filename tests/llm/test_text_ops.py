"""Operators 3, 5, 6, 7, 8 and 10 against brute force."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import exact_dedup, graph, jaccard, pii, secrets, sharding, toxicity


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("block", [4, 4096])
def test_exact_duplicates(edge_docs, edge_rows, block):
    rows = exact_dedup.exact_duplicates(edge_docs, block).collect()
    groups = defaultdict(list)
    for d, t in edge_rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0))
    want = []
    for text, g in groups.items():
        best = min(g)
        first = True
        for m in sorted(g):
            want.append((None if m[1] else m[2], None if best[1] else best[2], len(g), first, sha(text)))
            first = False
    assert sorted(map(key, [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows])) == sorted(map(key, want))


def test_block_names_of_different_lengths(spark):
    texts = ["ab" * n for n in range(1, 40)] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = exact_dedup.exact_duplicates(docs, 3).collect()
    assert all(r.group_size == 2 and r.keep_id == r.doc_id % 39 for r in rows)


def test_base_spans_equal_the_patterns(edge_rows):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for x in [t or "" for _, t in edge_rows] + ["TOKEN='abc' secret=longenough1 PassWord : \"p4ss/word+=\"", "tokKen=abcdefghij", "passwd:=========="]:
        want = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
        assert secrets.base_spans(x) == sorted(want)


@pytest.fixture(scope="module")
def secret_docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9)))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(240):
        w = [word() for _ in range(40)]
        if i % 3 == 0:
            w[20] = f'token = "{hexa(40)}"' if i % 2 else f"password: {hexa(36)}"
        rows.append((i, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_crf_adds_spans_and_keeps_base(spark, secret_docs, edge_docs, no_docs):
    crf = secrets.fit(secret_docs)
    rows = secrets.scan(secret_docs.unionByName(edge_docs.select("doc_id", "text")), crf).collect()
    assert len(rows) == 240 + edge_docs.count()
    for r in rows:
        base = [s for s in r.spans.split(",") if s and not s.startswith("crf")]
        assert sha(",".join(base)) == r.base_sha256 and len(base) == r.n_assign + r.n_access + r.n_hex
    plain = "some words and a password 0f1e2d3c4b5a69788796a5b4c3d2e1f more words here"  # 31 digits: no base match
    base, more = crf.scan(plain)
    assert not base and [plain[s:e] for s, _, e in more] == ["0f1e2d3c4b5a69788796a5b4c3d2e1f"]
    assert crf.scan("only common words stand here in this line of text") == ([], [])
    assert "0f1e2d" not in secrets.redact(plain, crf)
    assert secrets.scan(no_docs, crf).count() == 0
    assert secrets.fit(no_docs).scan("token = abcdefgh12")[0] == [(0, 0, 18)]


def test_pruned_viterbi_equals_whole_viterbi(secret_docs):
    crf = secrets.fit(secret_docs)
    for r in secret_docs.limit(60).collect():
        tokens = r.text.split()
        odd = [x for x in tokens if crf.facts(x) is not None]
        file = crf.sum(secrets.file_features(tokens, len(odd), any(map(secrets.has_keyword, tokens))))
        near = [crf.beside(x) for x in tokens]
        s = []
        for i, x in enumerate(tokens):
            around = [f"{at}:{f}" for k, at in ((i + 1, "next"), (i - 1, "prev"), (i - 2, "prev2")) if 0 <= k < len(tokens) for f in near[k]]
            s.append(crf.sum(secrets.own_features(x)) + crf.sum(around) + file)
        whole = crf.decode(np.array(s))
        at = [m.span() for m in re.finditer(r"\S+", r.text)]
        base, more = crf.scan(r.text)
        want, i = [], 0
        while i < len(whole):
            if whole[i] != secrets.O:
                k = i
                while k + 1 < len(whole) and whole[k + 1] == secrets.I:
                    k += 1
                want.append((i, k))
                i = k
            i += 1
        assert more == secrets.added(r.text, base, want) and at


def brute_links(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d
    for a, b in itertools.combinations(sorted(sets), 2):
        i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * i >= 80 * u:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def test_jaccard(spark, edge_rows):
    rng = random.Random(5)
    rows = [(d, t) for d, t in dict(r for r in edge_rows if r[0] is not None).items()]
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    common = " ".join(f"boiler{i}" for i in range(60))
    for i in range(60):  # copies of one text, each with some words changed: a star
        w = base[:]
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
        rows.append((100 + i, " ".join(w)))
    for i in range(60):  # a chain, and a passage in many texts
        rows.append((200 + i, " ".join(f"c{j}" for j in range(i * 3, i * 3 + 60))))
        rows.append((300 + i, common + " " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.choice((3, 10, 40))))))
    rows += [(400 + i, t) for i, t in enumerate(["a b c d e f", "A B\tc D e F", "a b c d", "a b c d", "a b c", "", None])]
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_links(rows)


def test_jaccard_edge_rows(edge_docs, edge_rows, no_docs):
    rows = jaccard.similar_components(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    assert all(r.component_id == r.doc_id for r in rows if not r.n_shingles)
    assert [r.component_id for r in rows if r.doc_id == 15] == [15, 15] and {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    assert jaccard.similar_components(no_docs).count() == 0


def test_least_overlap_filter_is_lossless():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        m, p = jaccard.choose(np.sort(rng.integers(1, 1000, n)), n)
        assert 1 <= m <= 8 and p == n - jaccard.least_overlap(n) + m <= n


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1100)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def personal(x):
    def good(k, v):
        d = re.sub("[^0-9]", "", v)
        luhn = sum((c if i % 2 == 0 else c * 2 - 9 * (c > 4)) for i, c in enumerate(map(int, reversed(d)))) % 10 == 0
        return (True, k != 1 or all(int(p) <= 255 for p in v.split(".")), 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15)[k]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, x) if good(k, m[0]))


def test_pii_base(spark, edge_rows, no_docs):
    odd = ["a@b.com@c.de x@y.zz_q@r.st .a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.400 01.002.3.4", "é 4111 1111 1111 1111 4111-1111-1111-1111x 378282246310005",
           "+1 (555) 123-4567 +49.30.1234567- +1234567890123456 ++12 345 678 901", "a@b.com_x@y.zz 😀 q@w.e +1 555-555-5555", "1 " * 4000, "x" * 30_000 + "@"]
    rows = edge_rows + [(500 + i, t) for i, t in enumerate(odd)]
    got = pii.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    listed = lambda t: sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in personal(t or "")))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == sorted(
        (d is None, d or 0, listed(t), *(sum(k == i for _, k, _ in personal(t or "")) for i in range(4))) for d, t in rows)
    assert pii.scan(no_docs).count() == 0


def test_pii_terms(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("lorem ipsum dolor sit amet elit sed do".split())
    rows = [(i, " ".join([*(word() for _ in range(20)), *(["Quillon", "joe@example.com"] if i < 12 else []), *(word() for _ in range(20))])) for i in range(300)]
    rows.append((900, "Quillon lorem \\E(x Quillon"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.scan(docs).collect()}
    texts = dict(rows)
    terms = {d: [texts[d][int(x.split(":")[1]):int(x.split(":")[2])] for x in s.split(",") if x.startswith("term")] for d, s in got.items()}
    assert all(t == ["Quillon"] for d, t in terms.items() if d < 12) and not any(t for d, t in terms.items() if 12 <= d < 900)
    assert terms[900] == ["Quillon", "Quillon"]
    clean = docs.filter("doc_id = 3").select(pii.sanitise(F.col("text"), F.lit(got[3])).alias("t")).first().t
    assert "joe@" not in clean and "Quillon" not in clean and "[...] [EMAIL]" in clean


def test_pii_terms_in_any_form(spark):
    """Forms of a word count together and all go; identifiers count; three words are three words, however long."""
    rng = random.Random(2)
    word = lambda: rng.choice("lorem ipsum dolor sit amet elit sed do".split())
    long = ["loremipsumdolorsitamet" * 2, "consecteturadipiscing" * 2]
    forms = ["Quillon", "Quillon,", "quillon", "(QUILLON)"]
    rows = [(i, " ".join([*(word() for _ in range(20)), *([forms[i % 4], *long, "joe@example.com", "-", "Emp-4471;", "acct#88"] if i < 12 else long * (i % 3)), *(word() for _ in range(20))])) for i in range(300)]
    rows.append((900, "lorem [quillon] emp-4471 x4111 1111 1111 1111 acct#88."))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    got = {r.doc_id: r.spans for r in pii.scan(docs).collect()}
    terms = {d: [texts[d][int(x.split(":")[1]):int(x.split(":")[2])] for x in s.split(",") if x.startswith("term")] for d, s in got.items()}
    assert all(terms[i] == [forms[i % 4].strip("(),"), "Emp-4471", "acct#88"] for i in range(12))
    assert terms[900] == ["quillon", "emp-4471", "acct#88"] and not any(terms[i] for i in range(12, 300))
    clean = docs.filter("doc_id = 900").select(pii.sanitise(F.col("text"), F.lit(got[900])).alias("t")).first().t
    assert clean == "lorem [[...]] [...] x[CARD] [...]."
    over = spark.range(1).select(pii.sanitise(F.lit("a x4111 1111 b"), F.lit("term:2:7,card:3:12")).alias("t")).first().t
    assert over == "a [...][CARD] b"


def brute_segments(scores):
    """All maximal segments, by their recursive definition."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[0] + 1e-9 or abs(s - best[0]) <= 1e-9 and j - i < best[2] - best[1]):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return [*brute_segments(scores[:i]), (i, j, s), *[(a + j, b + j, x) for a, b, x in brute_segments(scores[j:])]]


def test_segments_equal_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        hits = {i: rng.choice((1.0, 2.5, 4.0)) + rng.random() / 100 for i in range(25) if rng.random() < 0.3}
        gap = -0.7371
        got = toxicity.segments([hits.get(i, gap) for i in range(25)])
        want = brute_segments([hits.get(i, gap) for i in range(25)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_segments_of_mixed_scores_and_time():
    rng = random.Random(5)
    for _ in range(100):
        scores = [rng.uniform(-2, 1.5) for _ in range(25)]
        got, want = toxicity.segments(scores), brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    seconds = []
    for n in (20_000, 200_000):  # hits that never merge: each stays a candidate
        began = time.perf_counter()
        assert len(toxicity.segments([1.0, -1.5] * n)) == n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 40 * seconds[0]  # ten times the hits, far from a hundred times the seconds


def test_toxicity_weights_by_hand():
    got = toxicity._weights([("vil", 6, 2), ("vile ", 5, 0), ("ok ", 0, 30)], 20, 80)
    logit = lambda p: np.log(p / (1 - p))
    vil = (6 + 20 * 0.2) / 28
    want = {"vil": vil, "vile ": (5 + 20 * vil) / 25, "ok ": 20 * 0.2 / 50}
    assert got.keys() == want.keys() and all(np.isclose(got[f], logit(p) - logit(0.2)) for f, p in want.items())
    assert got["ok "] < 0 < got["vil"] < got["vile "]
    model = toxicity.Model(got)
    assert model.weight("(vilest!)") == got["vil"] - toxicity.COST and model.weight("42") == model.weight("unseen") == -toxicity.COST
    assert toxicity.tokens_of("Ab c\u6f22\u5b57\u8a9e, d") == ["ab", "c\u6f22", "\u6f22\u5b57", "\u5b57\u8a9e", "d"]


def test_labelled_rows_are_bounded_and_distinct_texts_stay(spark):
    label = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.range(3000).select(F.lit(label).cast("bigint").alias("doc_id"), F.concat(F.lit("text number "), F.col("id"), F.lit(" of one id")).alias("text"))
    assert toxicity._labelled(docs, spark.createDataFrame([(label, 1)], "doc_id bigint, toxic int"), 40).count() <= 40
    shared = "these are the very words that many documents share among them"
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5][:60]
    rng = random.Random(8)
    made = {i: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(200)) for i in ids}
    own = made.__getitem__
    rows = [(i, f"{shared} {own(i)}") for i in ids] + [(i, f"{shared} {own(ids[0])} end") for i in ids[:2]]
    marks = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id bigint, toxic int")
    kept = toxicity._labelled(spark.createDataFrame(rows, "doc_id bigint, text string"), marks, 1000)
    assert kept.count() == 61  # the near copy of the first text goes under its label and stays under the other


def test_toxicity(spark, edge_docs, no_docs):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [word() for _ in range(60)]
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(("vileword", "nastyone"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs.unionByName(edge_docs.select("doc_id", "text")), model).collect()
    assert len(got) == 600 + edge_docs.count()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 100]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    only = toxicity.fit(docs, marks.filter("toxic = 0"))  # one class: every text alike
    assert len({r.score for r in toxicity.score(docs, only).collect()}) == 1
    assert toxicity.score(no_docs, model).count() == 0 and toxicity.fit(no_docs, marks).weights == {}


def test_no_evidence_means_clean(spark, edge_docs, tmp_path):
    """Without clean and toxic labels drop_toxic keeps every row; with mostly toxic ones, null and empty texts stay."""
    import corpus_pipeline
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()] + [(100 + i, f"vileword number{i} here and more{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name, labels in (("none", []), ("elsewhere", [(5000 + i, i % 2) for i in range(20)]), ("toxic", [(100 + i, 1) for i in range(40)]), ("clean", [(100 + i, 0) for i in range(40)])):
        marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{name}").count() == len(rows), name
        assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()} == {0}
    mostly = spark.createDataFrame([(100 + i, int(i % 8 > 0)) for i in range(40)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, mostly)).collect()
    assert all(r.predicted == 0 for r in got if r.doc_id in (1, 2, 3))


def test_written_shards_hold_every_row(spark, edge_docs, edge_rows, tmp_path):
    key = sharding.write_shards(edge_docs, f"{tmp_path}/out", 5000, 3)
    assert key == "shard_"  # the table has a column shard of its own
    held = []
    for folder in (tmp_path / "out").glob("shard_=*"):
        rows = spark.read.parquet(str(folder)).collect()
        assert sum(len((r.text or "").encode()) for r in rows) <= 5000 or len(rows) == 1
        assert all(r.row == r.shard == "mine" for r in rows)
        held += [(r.doc_id, r.text) for r in rows]
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(held, key=order) == sorted(edge_rows, key=order)


@pytest.mark.parametrize("limit", [50, 5000, 10 ** 9])
def test_shards(edge_docs, edge_rows, no_docs, limit):
    rows = sharding.shards(edge_docs, limit, 3).collect()
    assert len(rows) == len(edge_rows)
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r.n_bytes)
        assert len(r.shard) == r.depth
    for r in rows:
        assert r.shard_bytes == sum(held[r.shard]) and r.shard_docs == len(held[r.shard])
        assert r.shard_bytes <= limit or r.shard_docs == 1
    names = sorted(held)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    for name in names:  # a split happened only where it was needed
        if name:
            inside = [r for r in rows if r.shard.startswith(name[:-1])]
            assert sum(r.n_bytes for r in inside) > limit and len(inside) > 1
    assert sharding.shards(no_docs, limit).count() == 0


def test_secret_sample_is_bounded_by_rows(spark, monkeypatch):
    """Rows without ids or with one id bring no more windows than the sample allows, however many there are."""
    from ridgeline.llm import secrets
    monkeypatch.setattr(secrets, "SAMPLE_HITS", 10)
    monkeypatch.setattr(secrets, "SAMPLE_PLAIN", 5)
    seen = []
    monkeypatch.setattr(secrets, "train", lambda pieces: seen.append(len(pieces)))
    rows = [(None if i % 2 else 7, f"some words {i} password = abcdefgh{i} and more words {i}") for i in range(3000)] + [(None, "token: 0123456789abc")] * 2000
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    secrets.fit(df)
    secrets.fit(spark.createDataFrame([(i, f"plain {i}") for i in range(500)] + rows[:4], "doc_id bigint, text string"))
    secrets.fit(df.limit(0))
    assert 10 <= seen[0] <= 15 * (secrets.WINDOWS + 2) and 4 <= seen[1] <= 15 * (secrets.WINDOWS + 2) and seen[2] == 0
