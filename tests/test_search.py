"""Searches against brute force, indexes by recall, analytics, mutation, and the catalogue."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vecframe.errors import IndexError_, SearchError, ValidationError
from vecframe.functions import metrics as M
from vecframe.operators import analytics as A
from vecframe.operators import index as I
from vecframe.operators import mutate
from vecframe.operators import search as S
from vecframe.plans.spec import Query


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[5] = x[7]
    rows = [(i, v.tolist(), int(i % 4)) for i, v in enumerate(x)] + [(300, None, 0), (301, [0.0] * 16, 1)]
    return x.astype(np.float64), spark.createDataFrame(rows, "id bigint, embedding array<float>, label int").cache()


def _brute(x, q, metric):
    if metric == "L2":
        return ((x - q) ** 2).sum(axis=1)
    s = x @ q
    return s / np.linalg.norm(x, axis=1) / np.linalg.norm(q) if metric == "COSINE" else -s if metric == "-" else s


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
def test_top_k(vectors, metric):
    x, df = vectors
    s = _brute(x, x[3], metric)
    got = S.top_k(df.where("id < 300"), "id", "embedding", x[3].tolist(), 10, metric).collect()
    order = np.lexsort((np.arange(300), s if metric == "L2" else -s))[:10]
    assert [r.id for r in got] == order.tolist()
    assert [r.score for r in got] == pytest.approx(s[order].tolist())


def test_batch_agrees_with_single_and_breaks_ties_by_key(vectors):
    x, df = vectors
    q = df.where("id in (5, 7, 20)")
    got = {(r.query_id, r.rank): r.id for r in S.batch_top_k(df, q, 4).collect()}
    assert got[5, 1] == 5 and got[5, 2] == 7 and got[7, 1] == 5 and got[7, 2] == 7
    one = [r.id for r in S.top_k(df, "id", "embedding", x[20].tolist(), 4).collect()]
    assert [got[20, i] for i in range(1, 5)] == one
    assert S.batch_top_k(df, q.limit(0), 4).count() == 0
    assert S.batch_top_k(df, q, 2, exclude_self=True).where("query_id = id").count() == 0


def test_turns_of_queries(vectors, monkeypatch):
    _, df = vectors
    whole = sorted(map(tuple, S.batch_top_k(df, df.where("id < 30"), 3).collect()))
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, S.batch_top_k(df, df.where("id < 30"), 3).collect())) == whole


def test_threshold_and_nearest(vectors):
    x, df = vectors
    s = _brute(x, x[3], "COSINE")
    assert {r.id for r in S.within(df, "id", "embedding", x[3].tolist(), 0.3).collect()} == set(np.flatnonzero(s >= 0.3).tolist())
    assert S.nearest(df.where("id <> 3"), "id", "embedding", x[3].tolist(), 0.99).count() == 0


def test_query_builder(vectors):
    x, df = vectors
    q = Query.over(df, "id", ["embedding"])
    assert q.filter(label=1).filter(id__lt=100).count() == 25
    assert q.exclude(label=1, id__gte=8).count() == 6
    assert q.none().filter(label=1).count() == 0 and not q.none().exists()
    assert [r["id"] for r in q.filter(label=2).only("id").limit(3).offset(1).ordered().collect()] == [6, 10, 14]
    hits = q.filter(label__in=[0, 2]).search(x[3].tolist(), limit=5, output_fields=["label"]).rows()
    assert len(hits) == 5 and {h["label"] for h in hits} <= {0, 2}
    assert len(q.search([x[1].tolist(), x[2].tolist()], limit=3).rows()) == 6
    with pytest.raises(SearchError):
        q.limit(3).search(x[0].tolist()).to_df()
    with pytest.raises(SearchError):
        Query.over(df, "id").search(x[0].tolist()).to_df()
    with pytest.raises(ValidationError):
        q.consistency("Sometimes")
    assert q.filter(label=1).spec.fingerprint() != q.filter(label=2).spec.fingerprint()
    assert q.get(id=3)["label"] == 3 and q.get_or_none(id=-1) is None and q.first()["id"] == 0


def test_hybrid(vectors):
    x, df = vectors
    q = Query.over(df, "id", ["embedding"]).filter(label__ne=3)
    got = q.hybrid_search([{"data": x[3].tolist(), "limit": 20}, {"data": x[9].tolist(), "limit": 20}], limit=5).rows()
    ranks = {}
    for v in (x[3], x[9]):
        s = _brute(x, v, "COSINE")
        ids = [i for i in np.lexsort((np.arange(300), -s)) if i % 4 != 3][:20]
        for rank, i in enumerate(ids, 1):
            ranks[i] = ranks.get(i, 0) + 1 / (60 + rank)
    want = sorted(ranks, key=lambda i: (-round(ranks[i], 12), i))[:5]
    assert [r["id"] for r in got] == want
    weighted = q.hybrid_search([{"data": x[3].tolist()}, {"data": x[9].tolist()}], ranker=("weighted", [1.0, 0.0]), limit=1).rows()
    assert weighted[0]["id"] == int(np.argmax(np.where(np.arange(300) % 4 == 3, -9, _brute(x, x[3], "COSINE"))))
    with pytest.raises(SearchError):
        q.hybrid_search([])


def test_sparse(spark):
    df = spark.createDataFrame([(1, {1: 0.5, 2: 1.0}), (2, {2: 2.0}), (3, {}), (4, None), (5, {9: 1.0})], "id int, sparse_embedding map<int,float>")
    assert [(r.id, r.score) for r in S.sparse_top_k(df, {1: 2.0, 2: 1.0}, 5).collect()] == [(1, 2.0), (2, 2.0)]
    index = I.postings(df, "id", "sparse_embedding", 0.0)
    assert [(r.id, r.score) for r in I.postings_top_k(index, {1: 2.0, 2: 1.0}, 5, "id").collect()] == [(1, 2.0), (2, 2.0)]
    assert I.postings(df, "id", "sparse_embedding", 0.5).where("id = 1").count() == 1
    many = S.sparse_join(df.withColumnRenamed("id", "query_id"), df, 1)
    assert {(r.query_id, r.id) for r in many.collect()} == {(1, 2), (2, 2), (5, 5)}


def test_binary(spark):
    rng = np.random.default_rng(2)
    raw = [rng.bytes(16) for _ in range(50)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)] + [(98, None), (99, bytearray(b"xy"))], "id int, h binary")
    bits = lambda b: bin(b).count("1")
    n = [int.from_bytes(b) for b in raw]
    ham = sorted((bits(n[0] ^ v), i) for i, v in enumerate(n))[:5]
    assert [(r.score, r.id) for r in I.binary_top_k(df, "id", "h", raw[0], 5).collect()] == ham
    jac = sorted((1 - bits(n[0] & v) / bits(n[0] | v), i) for i, v in enumerate(n))[:5]
    assert [r.id for r in I.binary_top_k(df, "id", "h", raw[0], 5, "JACCARD").collect()] == [i for _, i in jac]
    assert I.binary_bucket_top_k(df, "id", "h", raw[0], 3, bits=4).first().id == 0
    buckets = I.binary_buckets(spark.createDataFrame([(1, bytearray(raw[0])), (2, bytearray(raw[0]))], "id int, h binary"), "id", "h", 16)
    assert buckets.groupBy("bucket").count().where("count <> 2").count() == 0
    words = spark.createDataFrame([(x.tolist(),) for x in rng.standard_normal((1, 70))], "v array<double>").select(M.sign_words(F.col("v"), 70).alias("w")).first().w
    assert len(words) == 2


@pytest.mark.parametrize(("kind", "shortlist", "least"), [("FLAT", None, 0.9), ("SQ8", 40, 0.9), ("PQ", 60, 0.6)])
def test_inverted_file_recall(vectors, kind, shortlist, least):
    x, df = vectors
    ivf = I.InvertedFile.build(df.where("id < 300"), "id", "embedding", 10, kind, m=4, nbits=5)
    assert ivf.rows.count() == 300
    hit = 0
    for i in range(6):
        want = set(np.argsort(-_brute(x, x[i], "COSINE"), kind="stable")[:10].tolist())
        hit += len(want & {r.id for r in ivf.search(x[i].tolist(), 10, 8, shortlist=shortlist).collect()})
    assert hit / 60 >= least


@pytest.mark.parametrize(("kind", "shortlist"), [("FLAT", None), ("SQ8", None), ("PQ", 500), ("PQ", 1000)])
def test_registered_indexes_find_nine_of_ten(spark, kind, shortlist):
    """With the parameters of the catalogue, on the whole largest table: every hundredth vector against brute force."""
    path = Path("/root/testdata/sf0.1/embeddings.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    e = spark.read.parquet(str(path))
    rows = e.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    ivf = I.InvertedFile.build(e, "vec_id", "embedding", 32, kind)
    ivf.rows = ivf.rows.cache()
    hit = asked = 0
    for i in range(0, len(rows), 100):
        want = {rows[j].vec_id for j in np.argsort(-_brute(x, x[i], "COSINE"), kind="stable")[:10]}
        hit += len(want & {r.vec_id for r in ivf.search(x[i].tolist(), 10, shortlist=shortlist).collect()})
        asked += 10
    ivf.rows.unpersist()
    assert hit / asked >= 0.9


def test_lsh_and_descriptors(vectors):
    x, df = vectors
    got = [r.id for r in I.lsh_top_k(df, "id", "embedding", x[3].tolist(), 3, tables=6, bits=3).collect()]
    assert got[0] == 3
    assert I.IndexSpec("v").metric_type == "COSINE" and I.IndexSpec("v", "BIN_FLAT").metric_type == "HAMMING" and I.IndexSpec("v", "SPARSE_WAND").params == {"drop_ratio_build": 0.2}
    assert I.IndexSpec("v", "HNSW", params={"M": 8}).to_dict()["params"] == {"M": 8, "efConstruction": 256}
    assert I.auto_type(10)[0] == "FLAT" and I.auto_type(10**6) == ("IVF_FLAT", {"nlist": 4000})
    with pytest.raises(IndexError_):
        I.IndexSpec("v", "NO")


def test_rerank_keeps_unknown(spark):
    c = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "id int, distance double")
    e = spark.createDataFrame([(1, [0.0, 1.0]), (3, [1.0, 0.0])], "id int, embedding array<float>")
    assert [r.id for r in S.rerank(c, e, [1.0, 0.0], 3).collect()] == [3, 2, 1]
    assert [r.id for r in S.rerank(c, e.limit(0), [1.0, 0.0], 2).collect()] == [1, 2]


def test_mutation(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    delta = mutate.last_of(spark.createDataFrame([(2, "x", 1), (2, "y", 2), (4, "z", 1)], "id int, v string, n int"), "id", [F.desc("n")]).drop("n")
    assert sorted(map(tuple, mutate.upsert(base, delta, "id").fillna("").collect())) == [(1, "a"), (2, "y"), (3, ""), (4, "z")]
    assert sorted(r.id for r in mutate.delete_where(base, F.col("v") == "a").collect()) == [2, 3]
    assert sorted(r.id for r in mutate.delete_keys(base, base.where("id < 3"), "id").collect()) == [3]


def test_sliding_window_over_chunks(spark):
    rows = [(s, bool(s % 3)) for s in (0, 1, 2, 299, 300, 3599, 3600, 3700, 7300, 7300)]
    df = spark.createDataFrame(rows, "s bigint, hit boolean").select(F.timestamp_seconds("s").alias("ts"), "hit")
    got = {r.second: (r.lookups, r.hits) for r in A.sliding_hit_rate(df, "ts", F.col("hit"), 300).collect()}
    for s, _ in rows:
        live = [h for t, h in rows if s - 300 < t <= s]
        assert got[s] == (len(live), sum(live))


def test_simulation_matches_a_replay(spark):
    from vecframe.cache.policies import replay

    rng = np.random.default_rng(3)
    keys = [str(int(v) % 200) for v in rng.pareto(0.7, 3000)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)] + [(9999, None)], "n int, k string")
    got = {(r.policy, r.capacity): r.hits for r in A.simulate(df, "k", ["n"], ["lru", "arc"], [20, 50]).collect()}
    assert got == {(p, c): replay(p, c, keys) for p in ("lru", "arc") for c in (20, 50)}


def test_lru_in_blocks(spark):
    from vecframe.cache.policies import replay

    rng = np.random.default_rng(3)
    keys = [str(int(v) % 200) for v in rng.pareto(0.7, 3000)]
    df = spark.createDataFrame([(i // 3, i, k) for i, k in enumerate(keys)] + [(9999, 0, None)], "t int, n int, k string")
    for capacity, rows in ((20, 10_000), (20, 500), (150, 100)):
        assert tuple(A.lru_hits(df, "k", ["t", "n"], capacity, rows).first()) == (3000, replay("lru", capacity, keys))
    assert tuple(A.lru_hits(df.limit(0), "k", ["t", "n"], 5).first()) == (0, 0)


def test_every_catalogue_query_runs(spark, data):
    from vecframe.plans import catalogue

    for name, q in catalogue.queries().items():
        assert q(spark, data).columns, name
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark, data):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["vec_id", "label", "score"] and df.count() == 10
