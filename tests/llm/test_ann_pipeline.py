"""Operator 4 and the pipeline against brute force; registered SQL."""

import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from ridgeline.llm import ann, registry

SF = "/root/testdata/sf0.001"


def nearest(rows, every=20, top=20):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8}
    out = {}
    for q, v in good.items():
        if q % every == 0:
            out[q] = sorted((-float(x @ v), i) for i, x in good.items() if i != q)[:top]
    return out


def test_ann(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)]  # ties
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (2080, [float("inf")] * 8), (None, rows[1][1]), (2100, [1.0] * 3), rows[5], rows[20]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("vec_id", "embedding", "'x' as score", "1 as rank", "2 as cell")
    want = nearest(rows)
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    for q, w in want.items():
        assert [(k, i) for k, i, _ in got[q]] == [(k + 1, i) for k, (_, i) in enumerate(w)]
        assert np.allclose([s for *_, s in got[q]], [-s for s, _ in w], rtol=1e-12)
    assert ann.search(df.limit(0)).count() == 0


def test_ann_recall_with_few_candidates(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 4
    rows = [(i, (centres[rng.integers(40)] + rng.normal(size=8)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = nearest(rows)
    got = {}
    for r in ann.search(df, candidates=600, share=0.0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for _, i in w}) / 20 for q, w in want.items()]) >= 0.9


def test_ann_keeps_the_cell_at_the_stopping_distance(spark, monkeypatch):
    """Cells of a query hold two entries at least, so one besides itself, also where queries are ranked one by one."""
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 1)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    got = ann.search(df, every=10, candidates=2, share=0.0).select("query_id").distinct().count()
    assert got == 100


def test_traverse_equals_sorting():
    rng = np.random.default_rng(2)
    for _ in range(50):
        d1, d2 = rng.random(5), rng.random(6)
        held = rng.integers(0, 4, 30)
        order = sorted((d1[c // 6] + d2[c % 6], c) for c in range(30))
        total, far = 0, float("inf")
        for d, c in order:
            total += held[c]
            if total >= 12:
                far = d
                break
        assert ann.traverse(d1, d2, held.tolist(), 12) == far


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = E.queries()[name](spark, SF)
    want = con.sql(registry.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(want.select(",".join(cols)).fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).unionByName(spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0)], docs.schema))
    docs = docs.unionByName(extra).selectExpr("*", "'mine' as kept", "1 as set_id")
    names = docs.columns
    rows = {0: docs.collect()}
    for k, (name, work) in enumerate(corpus_pipeline.STAGES):
        out = work(spark, docs, SF)
        rows[k + 1] = out.collect()
        if k < 4:
            assert out.columns == names
            docs = spark.createDataFrame(rows[k + 1], docs.schema)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in rows[1]:
        groups.setdefault(norm(r.text), []).append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in rows[2]) == sorted(min(g)[1] for g in groups.values())
    sets = {}
    for r in rows[2]:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert sorted(r.doc_id for r in rows[3]) == [d for d in ids if top(d) == d]
    assert sorted(r.doc_id for r in rows[4]) == sorted(r.doc_id for r in rows[3])
    before = {r.doc_id: r for r in rows[3]}
    for r in rows[4]:
        if r.text != before[r.doc_id].text:
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)
        else:
            assert r == before[r.doc_id]
    assert {r.doc_id for r in rows[5]} == {r.doc_id for r in rows[4]}
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_copies_of_shared_and_missing_ids(spark):
    """Rows are kept by themselves, not by their doc_id."""
    a = " ".join(f"alpha{i}" for i in range(60))
    near, other = a.replace("alpha50", "beta"), " ".join(f"other{i}" for i in range(40))
    rows = [(15, a.replace("alpha51", "gamma")), (3, a), (15, " ".join(f"sole{i}" for i in range(40))), (20, other), (None, near), (None, other + " end"),
            (None, " ".join(f"null{i}" for i in range(50))), (None, " ".join(f"null{i}" for i in range(49))), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'mine' as place", "1 as place_", "2 as digest", "3 as covered", "4 as row", "5 as who", "6 as group")
    out = corpus_pipeline.drop_near_copies(spark, df, SF)
    assert out.columns == df.columns
    got = sorted(((r.doc_id or -1), (r.text or "")[:6], r.place, r.place_) for r in out.collect())
    assert got == sorted([(3, "alpha0", "mine", 1), (15, "sole0 ", "mine", 1), (20, "other0", "mine", 1), (-1, "null0 ", "mine", 1), (7, "", "mine", 1), (7, "", "mine", 1)])
    for work in (corpus_pipeline.drop_exact_copies, corpus_pipeline.cover_secrets):
        out = work(spark, df, SF)
        found = out.collect()
        assert out.columns == df.columns and {(r.place, r.place_, r.digest, r.covered) for r in found} == {("mine", 1, 2, 3)}
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), SF).count() == 0
