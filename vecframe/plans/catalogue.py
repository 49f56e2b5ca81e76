"""Queries of the engine's own operators over the test tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecframe.functions import metrics as M
from vecframe.operators import analytics as A
from vecframe.operators import index as I
from vecframe.operators import mutate
from vecframe.operators import search as S
from vecframe.plans.spec import Query

Make = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Make] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Make], Make]:
    def add(f: Make) -> Make:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Make]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_KEYS = {"part": "p_partkey", "orders": "o_orderkey", "customer": "c_custkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "doc_entities": "id"}


def _over(spark: SparkSession, d: str, name: str) -> Query:
    vectors = {"embeddings": ["embedding"], "doc_entities": ["embedding"]}.get(name, [])
    return Query.over(_t(spark, d, name), _KEYS[name], vectors, {"events": "event_type", "doc_entities": "partition_name"}.get(name))


def _all(q: Query, *columns: str | Column) -> DataFrame:
    """The rows of a query, without the limit a read has otherwise."""
    return q.base().select(*columns)


def _ids(df: DataFrame, ids: Sequence[int], key: str, vector: str) -> list[list[float]]:
    """A few stated query vectors."""
    got = {r[0]: list(r[1]) for r in df.where(F.col(key).isin(*ids)).select(key, vector).collect()}
    return [got[i] for i in ids]


# --- predicates ------------------------------------------------------------------------------------------------


def _filter(name: str, table: str, sql_where: str, build: Callable[[Query], Query], *columns: str) -> None:
    cols = columns or (_KEYS[table],)
    _QUERIES[name] = lambda spark, d: _all(build(_over(spark, d, table)), *cols)
    _SQL[name] = f"SELECT {', '.join(cols)} FROM {table} WHERE {sql_where}"


_filter("filter_eq", "part", "p_brand = 'Brand#23'", lambda q: q.filter(p_brand="Brand#23"), "p_partkey", "p_brand")
_filter("filter_ne", "orders", "o_orderstatus <> 'F'", lambda q: q.filter(o_orderstatus__ne="F"), "o_orderkey", "o_orderstatus")
_filter("filter_range", "orders", "o_totalprice > 1000 AND o_totalprice <= 90000", lambda q: q.filter(o_totalprice__gt=1000, o_totalprice__lte=90000), "o_orderkey")
_filter("filter_bounds", "part", "p_size >= 10 AND p_size < 20", lambda q: q.filter(p_size__gte=10, p_size__lt=20), "p_partkey", "p_size")
_filter("filter_in", "part", "p_size IN (1, 5, 9)", lambda q: q.filter(p_size__in=[1, 5, 9]), "p_partkey", "p_size")
_filter("filter_in_empty", "part", "false", lambda q: q.filter(p_size__in=[]), "p_partkey")
_filter("filter_nin", "orders", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", lambda q: q.filter(o_orderpriority__nin=["1-URGENT", "2-HIGH"]), "o_orderkey")
_filter("filter_like", "part", "p_type LIKE 'PROMO%'", lambda q: q.filter(p_type__like="PROMO%"), "p_partkey", "p_type")
_filter("filter_not", "customer", "NOT (c_acctbal > 0)", lambda q: q.filter("not (c_acctbal > 0)"), "c_custkey")
_filter("exclude_multi", "customer", "c_mktsegment <> 'BUILDING' AND NOT (c_acctbal > 5000)", lambda q: q.exclude(c_mktsegment="BUILDING", c_acctbal__gt=5000), "c_custkey")
_filter("filter_repeated", "part", "p_size > 5 AND p_size > 40", lambda q: q.filter(p_size__gt=5).filter(p_size__gt=40), "p_partkey")
_filter(
    "filter_raw_expr", "lineitem",
    "(l_quantity > 45 AND l_returnflag = 'R') OR (l_discount >= 0.09 AND NOT (l_linestatus = 'O'))",
    lambda q: q.filter("(l_quantity > 45 and l_returnflag == \"R\") or (l_discount >= 0.09 && !(l_linestatus == 'O'))"),
    "l_orderkey", "l_linenumber", "l_quantity",
)
_filter("filter_exists", "doc_entities", "author IS NOT NULL AND title IS NULL", lambda q: q.filter(author__exists=True, title__exists=False))
_filter("json_path_filter", "events", "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 50", lambda q: q.filter('props["k"] > 50'), "event_id")
_JSON = "CASE WHEN json_valid(metadata) THEN metadata END"
_filter("json_path_exists", "doc_entities", f"json_extract_string({_JSON}, '$.rev') IS NOT NULL", lambda q: q.filter('exists metadata["rev"]'))
_TAGS = f"TRY_CAST(json_extract({_JSON}, '$.tags') AS VARCHAR[])"
_filter("json_contains", "doc_entities", f"list_contains({_TAGS}, 'payload')", lambda q: q.filter('json_contains(metadata["tags"], "payload")'))
_filter("json_contains_all", "doc_entities", f"list_has_all({_TAGS}, ['payload', 'alias'])", lambda q: q.filter('json_contains_all(metadata["tags"], ["payload", "alias"])'))
_filter("json_contains_any", "doc_entities", f"list_has_any({_TAGS}, ['payload', 'deadline', 'alias'])", lambda q: q.filter('json_contains_any(metadata["tags"], ["payload", "deadline", "alias"])'))


def _words(spark: SparkSession, d: str) -> Query:
    df = _t(spark, d, "part").withColumn("words", F.split("p_name", " "))
    return Query.over(df, "p_partkey")


def _array_filter(name: str, sql_where: str, build: Callable[[Query], Query]) -> None:
    _QUERIES[name] = lambda spark, d: _all(build(_words(spark, d)), "p_partkey")
    _SQL[name] = f"SELECT p_partkey FROM (SELECT *, string_split(p_name, ' ') AS words FROM part) WHERE {sql_where}"


_array_filter("array_contains", "list_contains(words, 'red')", lambda q: q.filter(words__array_contains="red"))
_array_filter("array_contains_all", "list_has_all(words, ['blue', 'bolt'])", lambda q: q.filter(words__array_contains_all=["blue", "bolt"]))
_array_filter("array_contains_any", "list_has_any(words, ['gear', 'ring'])", lambda q: q.filter(words__array_contains_any=["gear", "ring"]))
_array_filter("array_length", "len(words) = 2", lambda q: q.filter(words__array_length=2))


# --- builder verbs ---------------------------------------------------------------------------------------------


@_query("SELECT o_orderkey, o_totalprice FROM orders")
def project_only(spark: SparkSession, d: str) -> DataFrame:
    return _all(_over(spark, d, "orders").only("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def limit_offset(spark: SparkSession, d: str) -> DataFrame:
    return _over(spark, d, "orders").only("o_orderkey", "o_totalprice").limit(50).offset(100).ordered()


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1")
def first_row(spark: SparkSession, d: str) -> DataFrame:
    return _over(spark, d, "orders").filter(o_orderstatus="O").only("o_orderkey", "o_orderstatus").limit(1).ordered()


@_query("SELECT count(*) AS count FROM orders")
def count_all(spark: SparkSession, d: str) -> DataFrame:
    return _over(spark, d, "orders").count_df()


@_query("SELECT count(*) AS count FROM orders WHERE o_totalprice > 100000")
def count_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _over(spark, d, "orders").filter(o_totalprice__gt=100000).count_df()


@_query("SELECT count(*) > 0 AS found FROM (SELECT 1 FROM orders WHERE o_totalprice > 100000 LIMIT 1)")
def exists_any(spark: SparkSession, d: str) -> DataFrame:
    return _over(spark, d, "orders").filter(o_totalprice__gt=100000).exists_df()


@_query("SELECT o_orderkey FROM orders WHERE false")
def none_rows(spark: SparkSession, d: str) -> DataFrame:
    return _over(spark, d, "orders").none().filter(o_totalprice__gt=1).only("o_orderkey").to_df()


@_query("SELECT id, partition_name FROM doc_entities WHERE partition_name IN ('p_notes', 'p_guides')")
def partition_read(spark: SparkSession, d: str) -> DataFrame:
    return _all(_over(spark, d, "doc_entities").using_partitions("p_notes", "p_guides"), "id", "partition_name")


# --- vector search ---------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_DOT = "list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_L2 = "power(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 2)"


def _single(name: str, expr: str, direction: str, metric: str) -> None:
    def make(spark: SparkSession, d: str) -> DataFrame:
        e = _t(spark, d, "embeddings")
        (q,) = _ids(e, [0], "vec_id", "embedding")
        return _over(spark, d, "embeddings").search(q, limit=10, metric_type=metric).to_df().select("vec_id", F.round("score", 6).alias("score"))

    _QUERIES[name] = make
    _SQL[name] = f"SELECT vec_id, round(s, 6) AS score FROM (SELECT e.vec_id, {expr} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY s {direction}, vec_id LIMIT 10"


_single("topk_cosine", _COS, "DESC", "COSINE")
_single("topk_ip", _DOT, "DESC", "IP")
_single("topk_l2", _L2, "ASC", "L2")


@_query(f"SELECT vec_id, label, round(s, 6) AS score FROM (SELECT e.vec_id, e.label, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 3, 5)) ORDER BY s DESC, vec_id LIMIT 10")
def filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    (q,) = _ids(_t(spark, d, "embeddings"), [0], "vec_id", "embedding")
    hits = _over(spark, d, "embeddings").filter(label__in=[1, 3, 5]).search(q, limit=10, output_fields=["label"]).to_df()
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


_USABLE = "len(embedding) = 128 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_FRESH = f"(SELECT id, any_value(partition_name) AS partition_name, any_value(embedding) AS embedding FROM doc_entities WHERE embedding IS NOT NULL AND {_USABLE} GROUP BY id)"


def _fresh(spark: SparkSession, d: str) -> DataFrame:
    """Usable vectors of the entities, each id once."""
    v = F.col("embedding")
    good = (F.size(v) == 128) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return _t(spark, d, "doc_entities").where(good).select("id", "partition_name", "embedding").dropDuplicates(["id"])


@_query(
    f"WITH f AS {_FRESH}, q AS (SELECT id AS query_id, embedding FROM f WHERE id % 100 = 0) SELECT query_id, rank, id, round(s, 6) AS score FROM (SELECT q.query_id, e.id, round({_COS}, 10) AS s, CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY round({_COS}, 10) DESC, e.id) AS INT) AS rank FROM f e, q) WHERE rank <= 5"
)
def batch_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _fresh(spark, d)
    hits = S.batch_top_k(e, e.where("id % 100 = 0"), 5, "id", "embedding")
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@_query(f"WITH f AS {_FRESH} SELECT e.id, round({_COS}, 6) AS score FROM f e, (SELECT embedding FROM f ORDER BY id LIMIT 1) q WHERE e.partition_name = 'p_notes' ORDER BY {_COS} DESC, e.id LIMIT 10")
def partition_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _fresh(spark, d)
    q = list(e.orderBy("id").select("embedding").first()[0])
    hits = Query.over(e, "id", ["embedding"], "partition_name").using_partitions("p_notes").search(q, limit=10).to_df()
    return hits.select("id", F.round("score", 6).alias("score"))


@_query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS} >= 0.2")
def threshold_search(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    (q,) = _ids(e, [0], "vec_id", "embedding")
    return S.within(e, "vec_id", "embedding", q, 0.2).select("vec_id", F.round("score", 6).alias("score"))


@_query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 AND {_COS} >= 0.1 ORDER BY {_COS} DESC, e.vec_id LIMIT 1")
def nearest_probe(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    (q,) = _ids(e, [0], "vec_id", "embedding")
    return S.nearest(e.where("vec_id <> 0"), "vec_id", "embedding", q, 0.1).select("vec_id", F.round("score", 6).alias("score"))


@_query(f"SELECT h.vec_id, round(h.s, 6) AS score, coalesce(d.lang, '') AS lang, coalesce(d.n_chars, -1) AS n_chars FROM (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, vec_id LIMIT 10) h LEFT JOIN documents d ON d.doc_id = 5000000 + h.vec_id")
def topk_hydrated(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    (q,) = _ids(e, [0], "vec_id", "embedding")
    docs = _t(spark, d, "documents").withColumn("vec_id", F.col("doc_id") - 5000000)
    return S.hydrate(S.top_k(e, "vec_id", "embedding", q, 10), docs, "vec_id", ["lang", "n_chars"]).select("vec_id", F.round("score", 6).alias("score"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


def _binary(spark: SparkSession, d: str, metric: str) -> DataFrame:
    b = _t(spark, d, "binary_hashes")
    q = bytes(b.where("hash_vector is not null").orderBy("id").select("hash_vector").first()[0])
    return I.binary_top_k(b, "id", "hash_vector", q, 10, metric).select("id", F.round("score", 6).alias("score"))


_BITS = "(SELECT id, CAST(hash_vector AS BIT) AS b FROM binary_hashes WHERE octet_length(hash_vector) = 32)"
_FIRST_BITS = f"(SELECT b AS qb FROM {_BITS} ORDER BY id LIMIT 1)"


@_query(f"SELECT id, CAST(bit_count(xor(b, qb)) AS DOUBLE) AS score FROM {_BITS}, {_FIRST_BITS} ORDER BY score, id LIMIT 10")
def binary_hamming(spark: SparkSession, d: str) -> DataFrame:
    return _binary(spark, d, "HAMMING")


@_query(f"SELECT id, round(1 - bit_count(b & qb) / CAST(bit_count(b | qb) AS DOUBLE), 6) AS score FROM {_BITS}, {_FIRST_BITS} ORDER BY 1 - bit_count(b & qb) / CAST(bit_count(b | qb) AS DOUBLE), id LIMIT 10")
def binary_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _binary(spark, d, "JACCARD")


_POSTINGS = "(SELECT id, unnest(map_keys(sparse_embedding)) AS term, CAST(unnest(map_values(sparse_embedding)) AS DOUBLE) AS w FROM sparse_docs)"
_FIRST_SPARSE = "(SELECT min(id) FROM sparse_docs WHERE cardinality(sparse_embedding) > 0)"


def _sparse_query(df: DataFrame) -> dict[int, float]:
    return dict(df.where(F.size("sparse_embedding") > 0).orderBy("id").select("sparse_embedding").first()[0])


@_query(f"WITH p AS {_POSTINGS} SELECT c.id, round(sum(c.w * q.w), 6) AS score FROM p c JOIN p q ON c.term = q.term AND q.id = {_FIRST_SPARSE} GROUP BY c.id ORDER BY sum(c.w * q.w) DESC, c.id LIMIT 10")
def sparse_ip(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "sparse_docs")
    return S.sparse_top_k(df, _sparse_query(df), 10).select("id", F.round("score", 6).alias("score"))


@_query(f"WITH p AS {_POSTINGS} SELECT c.id, round(sum(c.w * q.w), 6) AS score FROM p c JOIN p q ON c.term = q.term AND q.id = {_FIRST_SPARSE} GROUP BY c.id ORDER BY sum(c.w * q.w) DESC, c.id LIMIT 10")
def sparse_inverted(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "sparse_docs")
    return I.postings_top_k(I.postings(df, "id", "sparse_embedding", 0.0), _sparse_query(df), 10, "id").select("id", F.round("score", 6).alias("score"))


@_query(f"WITH p AS {_POSTINGS}, s AS (SELECT q.id AS query_id, c.id, sum(c.w * q.w) AS s FROM p c JOIN p q ON c.term = q.term AND q.id % 100 = 0 GROUP BY q.id, c.id) SELECT query_id, rank, id, round(s, 5) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS INT) AS rank FROM s) WHERE rank <= 5")
def sparse_batch(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "sparse_docs")
    hits = S.sparse_join(df.where("id % 100 = 0").withColumnRenamed("id", "query_id"), df, 5)
    return hits.select("query_id", "rank", "id", F.round("score", 5).alias("score"))


_LEG = "(SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS rk FROM (SELECT e.vec_id, {m} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {q}) q) QUALIFY rk <= 20)"


def _legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "embeddings")
    a, b = _ids(e, [0, 1], "vec_id", "embedding")
    return S.top_k(e, "vec_id", "embedding", a, 20), S.top_k(e, "vec_id", "embedding", b, 20, "L2")


@_query(f"SELECT vec_id, round(sum(1.0 / (60 + rk)), 6) AS score FROM (SELECT * FROM {_LEG.format(m=_COS, q=0)} UNION ALL SELECT vec_id, s, row_number() OVER (ORDER BY s, vec_id) AS rk FROM (SELECT e.vec_id, {_L2} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q) QUALIFY rk <= 20) GROUP BY vec_id ORDER BY round(sum(1.0 / (60 + rk)), 12) DESC, vec_id LIMIT 10")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    a, b = _ids(_t(spark, d, "embeddings"), [0, 1], "vec_id", "embedding")
    q = _over(spark, d, "embeddings").hybrid_search([{"data": a, "limit": 20}, {"data": b, "limit": 20, "param": {"metric_type": "L2"}}], limit=10)
    return q.to_df().select("vec_id", F.round("score", 6).alias("score"))


@_query(f"SELECT vec_id, round(sum(x), 6) AS score FROM (SELECT vec_id, 0.7 * (1 + s) / 2 AS x FROM {_LEG.format(m=_COS, q=0)} UNION ALL SELECT vec_id, 0.3 * (1 - 2 * atan(s) / pi()) AS x FROM (SELECT e.vec_id, {_L2} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY s, vec_id LIMIT 20)) GROUP BY vec_id ORDER BY round(sum(x), 12) DESC, vec_id LIMIT 10")
def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    a, b = _legs(spark, d)
    return S.weighted_fusion([(a, "COSINE", 0.7), (b, "L2", 0.3)], "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"))


_HITS = "(SELECT id, min(distance) AS distance FROM search_hits WHERE id IS NOT NULL AND distance IS NOT NULL GROUP BY id)"


@_query(f"WITH f AS {_FRESH} SELECT h.id, round(coalesce({_COS}, h.distance), 6) AS score FROM {_HITS} h LEFT JOIN f e ON e.id = h.id LEFT JOIN (SELECT embedding FROM f ORDER BY id LIMIT 1) q ON e.id IS NOT NULL ORDER BY round(coalesce({_COS}, h.distance), 10) DESC, h.id LIMIT 20")
def rerank_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = _fresh(spark, d)
    q = list(e.orderBy("id").select("embedding").first()[0])
    hits = _t(spark, d, "search_hits").where("id is not null and distance is not null").groupBy("id").agg(F.min("distance").alias("distance"))
    return S.rerank(hits, e.select("id", "embedding"), q, 20).select("id", F.round("score", 6).alias("score"))


@_query(f"SELECT query_id, id, round(s, 6) AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS}, 10) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 10) DESC, e.vec_id) AS rk FROM embeddings e JOIN embeddings q ON e.vec_id < q.vec_id WHERE round({_COS}, 10) >= 0.4) WHERE rk = 1")
def semantic_hits(spark: SparkSession, d: str) -> DataFrame:
    return A.semantic_hits(_t(spark, d, "embeddings"), "vec_id", "embedding", 0.4).select("query_id", F.col("id").alias("id"), F.round("similarity", 6).alias("similarity"))


@_query(f"WITH f AS {_FRESH} SELECT id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS total FROM f")
def normalize_vectors(spark: SparkSession, d: str) -> DataFrame:
    n = M.normalise(F.col("embedding"))
    return _fresh(spark, d).select("id", F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_query("WITH l AS (SELECT vec_id, unnest(generate_series(0, 63)) AS component, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), b AS (SELECT component, min(x) AS lo, max(x) AS hi FROM l GROUP BY component) SELECT vec_id, CAST(l.component AS INT) AS component, CAST(CASE WHEN hi > lo THEN floor((x - lo) / (hi - lo) * 255) ELSE 0 END AS INT) AS code FROM l JOIN b USING (component)")
def sq8_codes(spark: SparkSession, d: str) -> DataFrame:
    return I.sq8_codes(_t(spark, d, "embeddings"), "vec_id", "embedding", 64)


def _ivf(kind: str, shortlist: int | None) -> Make:
    def make(spark: SparkSession, d: str) -> DataFrame:
        e = _t(spark, d, "embeddings")
        (q,) = _ids(e, [0], "vec_id", "embedding")
        ivf = I.InvertedFile.build(e, "vec_id", "embedding", 32, kind)
        return ivf.search(q, 10, shortlist=shortlist).select("vec_id", F.round("score", 6).alias("score"))

    return make


_QUERIES["ivf_topk"] = _ivf("FLAT", None)
_QUERIES["sq8_topk"] = _ivf("SQ8", None)
_QUERIES["pq_topk"] = _ivf("PQ", 500)
_QUERIES["scann_topk"] = _ivf("PQ", 1000)


@_query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY s DESC, vec_id LIMIT 10")
def ivf_all_probes(spark: SparkSession, d: str) -> DataFrame:
    """Probing every cluster is the exact search."""
    e = _t(spark, d, "embeddings")
    (q,) = _ids(e, [0], "vec_id", "embedding")
    return I.InvertedFile.build(e, "vec_id", "embedding", 32).search(q, 10, 32).select("vec_id", F.round("score", 6).alias("score"))


def _lsh_sql() -> str:
    """Rows on the query's side of all planes of a table, scored exactly."""
    planes = I.lsh_planes(16, 4, 64)
    side = lambda v, p: f"list_dot_product({v}, [{', '.join(repr(float(x)) for x in p)}]) > 0"
    hit = " OR ".join("(" + " AND ".join(f"(({side('e.v', p)}) = ({side('q.v', p)}))" for p in table) + ")" for table in planes)
    vectors = "SELECT vec_id, embedding::DOUBLE[] AS v, embedding FROM embeddings"
    return f"WITH e AS ({vectors}), q AS ({vectors} WHERE vec_id = 0) SELECT vec_id, round(s, 6) AS score FROM (SELECT e.vec_id, {_COS} AS s FROM e, q WHERE {hit}) ORDER BY s DESC, vec_id LIMIT 10"


def _bucket_sql(bits: int, tables: int, of: str) -> list[str]:
    """Expressions of the buckets of a binary column."""
    return [" + ".join([f"(get_bit({of}::BIT, {b})::BIGINT << {i})" for i, b in enumerate(at)] + [f"({t}::BIGINT << 40)"]) for t, at in enumerate(I.sampled_bits(32, bits, tables))]


def _bucket_rows_sql() -> str:
    return f"SELECT bucket, count(*) AS rows FROM (SELECT unnest([{', '.join(_bucket_sql(12, 8, 'hash_vector'))}]) AS bucket FROM binary_hashes WHERE octet_length(hash_vector) = 32) GROUP BY bucket"


def _bucket_topk_sql() -> str:
    ours, theirs = _bucket_sql(4, 24, "b.hash_vector"), _bucket_sql(4, 24, "q.hash_vector")
    hit = " OR ".join(f"({a}) = ({b})" for a, b in zip(ours, theirs, strict=True))
    return f"""WITH q AS (SELECT hash_vector FROM binary_hashes WHERE hash_vector IS NOT NULL ORDER BY id LIMIT 1)
        SELECT b.id, round(bit_count(xor(b.hash_vector::BIT, q.hash_vector::BIT))::DOUBLE, 6) AS score
        FROM binary_hashes b, q WHERE octet_length(b.hash_vector) = 32 AND ({hit}) ORDER BY score, b.id LIMIT 10"""


@_query(_lsh_sql())
def lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    (q,) = _ids(e, [0], "vec_id", "embedding")
    return I.lsh_top_k(e, "vec_id", "embedding", q, 10, tables=16, bits=4).select("vec_id", F.round("score", 6).alias("score"))


@_query(_bucket_topk_sql())
def binary_bucket_topk(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "binary_hashes")
    q = bytes(b.where("hash_vector is not null").orderBy("id").select("hash_vector").first()[0])
    return I.binary_bucket_top_k(b, "id", "hash_vector", q, 10).select("id", F.round("score", 6).alias("score"))


@_query(_bucket_rows_sql())
def binary_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = I.binary_buckets(_t(spark, d, "binary_hashes"), "id", "hash_vector", 32)
    return b.groupBy("bucket").agg(F.count("*").alias("rows"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100")
def query_raw(spark: SparkSession, d: str) -> DataFrame:
    """The raw read's default limit is its feature; the key orders it."""
    q = _over(spark, d, "orders").filter("o_totalprice > 50000 and o_orderstatus == 'O'")
    return q.only("o_orderkey", "o_totalprice").limit(100).ordered()


@_query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.label IN (2, 4) OR e.vec_id < 50) ORDER BY s DESC, vec_id LIMIT 10")
def search_raw(spark: SparkSession, d: str) -> DataFrame:
    (q,) = _ids(_t(spark, d, "embeddings"), [3], "vec_id", "embedding")
    hits = _over(spark, d, "embeddings").filter("label in [2, 4] || vec_id < 50").search(q, limit=10).to_df()
    return hits.select("vec_id", F.round("score", 6).alias("score"))


_FILTERED_LEG = "(SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rk FROM (SELECT e.vec_id, {m} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {q}) q WHERE e.label <> 7{more}) QUALIFY rk <= 15)"


@_query(f"SELECT vec_id, round(sum(1.0 / (60 + rk)), 6) AS score FROM (SELECT * FROM {_FILTERED_LEG.format(m=_COS, q=0, more='')} UNION ALL SELECT * FROM {_FILTERED_LEG.format(m=_DOT, q=1, more=' AND e.vec_id < 300')}) GROUP BY vec_id ORDER BY round(sum(1.0 / (60 + rk)), 12) DESC, vec_id LIMIT 10")
def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The query's filter holds for every leg, a leg's own text for that leg."""
    a, b = _ids(_t(spark, d, "embeddings"), [0, 1], "vec_id", "embedding")
    q = _over(spark, d, "embeddings").filter(label__ne=7)
    fused = q.hybrid_search([{"data": a, "limit": 15}, {"data": b, "limit": 15, "expr": "vec_id < 300", "param": {"metric_type": "IP"}}], limit=10)
    return fused.to_df().select("vec_id", F.round("score", 6).alias("score"))


# --- writes ----------------------------------------------------------------------------------------------------


@_query(
    """
    WITH delta AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0
                   UNION ALL SELECT o_orderkey + 100000000, 1.0 FROM orders WHERE o_orderkey % 10 = 1)
    SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM delta)
    UNION ALL SELECT o_orderkey, round(o_totalprice, 6) FROM delta
    """
)
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    delta = o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    delta = delta.unionByName(o.where("o_orderkey % 10 = 1").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit(1.0).alias("o_totalprice")))
    return mutate.upsert(o, delta, "o_orderkey").select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@_query("SELECT id, max(ingested_at) AS ingested_at FROM doc_entities GROUP BY id")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return mutate.last_of(_t(spark, d, "doc_entities").select("id", "ingested_at"), "id", [F.desc("ingested_at")])


@_query("SELECT id FROM doc_entities WHERE NOT coalesce(score < 0.3, false)")
def delete_filter(spark: SparkSession, d: str) -> DataFrame:
    from vecframe.functions.predicates import parse, to_column

    return mutate.delete_where(_t(spark, d, "doc_entities"), to_column(parse("score < 0.3"))).select("id")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return mutate.delete_keys(_t(spark, d, "orders"), ids, "o_orderkey").select("o_orderkey")


@_query("SELECT partition_name, count(*) AS row_count FROM doc_entities GROUP BY partition_name")
def partition_stats(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "doc_entities").groupBy("partition_name").agg(F.count("*").alias("row_count"))


@_query("SELECT count(*) AS row_count FROM doc_entities")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "doc_entities").agg(F.count("*").alias("row_count"))


# --- cache analytics -------------------------------------------------------------------------------------------

_LOG = "(SELECT access_id, min(ts) AS ts, any_value(query_key) AS query_key, any_value(tier) AS tier, any_value(hit) AS hit, any_value(latency_ms) AS latency_ms FROM access_log GROUP BY access_id)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Each access once; redelivered rows repeat the others."""
    return _t(spark, d, "access_log").select("access_id", "ts", "query_key", "tier", "hit", "latency_ms").dropDuplicates(["access_id"])


@_query(
    f"""
    WITH s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS h FROM {_LOG} WHERE ts IS NOT NULL GROUP BY 1)
    SELECT second, CAST(sum(n) OVER w AS BIGINT) AS lookups, CAST(sum(h) OVER w AS BIGINT) AS hits, round(sum(h) OVER w / CAST(sum(n) OVER w AS DOUBLE), 6) AS hit_rate
    FROM s WINDOW w AS (ORDER BY second RANGE BETWEEN 299 PRECEDING AND CURRENT ROW)
    """
)
def hit_rate_sliding(spark: SparkSession, d: str) -> DataFrame:
    return A.sliding_hit_rate(_log(spark, d), "ts", F.col("hit")).select("second", "lookups", "hits", F.round("hit_rate", 6).alias("hit_rate"))


@_query(f"SELECT count(*) AS lookups, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN tier = 'l1' THEN 1 ELSE 0 END) AS BIGINT) AS l1_hits, CAST(sum(CASE WHEN tier = 'l2' THEN 1 ELSE 0 END) AS BIGINT) AS l2_hits, CAST(sum(CASE WHEN tier = 'semantic' THEN 1 ELSE 0 END) AS BIGINT) AS semantic_hits, CAST(sum(CASE WHEN tier = 'miss' THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM {_LOG}")
def tier_counters(spark: SparkSession, d: str) -> DataFrame:
    return A.tier_counters(_log(spark, d), "tier", F.col("hit"))


_BUCKET = "CASE " + " ".join(f"WHEN latency_ms <= {b} THEN {i}" for i, b in enumerate(A.LATENCY_BOUNDS)) + f" ELSE {len(A.LATENCY_BOUNDS)} END"


@_query(f"SELECT CAST({_BUCKET} AS INT) AS bucket, count(*) AS lookups FROM {_LOG} WHERE latency_ms IS NOT NULL GROUP BY 1")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.latency_histogram(_log(spark, d), "latency_ms")


@_query(
    f"""
    WITH h AS (SELECT {_BUCKET} AS bucket, count(*) AS n FROM {_LOG} WHERE latency_ms IS NOT NULL GROUP BY 1),
         r AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS run, sum(n) OVER () AS total FROM h)
    SELECT CAST(f AS DOUBLE) AS fraction, min([{", ".join(str(b) for b in A.LATENCY_BOUNDS)}, 'inf'::DOUBLE][CAST(bucket AS INT) + 1]) AS bound
    FROM r, (VALUES (0.5), (0.95), (0.99)) v(f) WHERE run >= total * CAST(f AS DOUBLE) GROUP BY f
    """
)
def latency_percentile(spark: SparkSession, d: str) -> DataFrame:
    return A.latency_percentiles(_log(spark, d), "latency_ms", (0.5, 0.95, 0.99))


@_query(f"SELECT query_key, count(*) AS accesses FROM {_LOG} WHERE query_key IS NOT NULL GROUP BY query_key")
def freq_estimate(spark: SparkSession, d: str) -> DataFrame:
    return A.frequencies(_log(spark, d), "query_key")


_EVENT_ORDER = "(SELECT user_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL)"


@_query(
    f"""
    WITH t AS {_EVENT_ORDER}, p AS (SELECT user_id, n, lag(n) OVER (PARTITION BY user_id ORDER BY n) AS before FROM t)
    SELECT count(*) AS accesses, CAST(sum(CASE WHEN before IS NOT NULL AND (SELECT count(DISTINCT x.user_id) FROM t x WHERE x.n > p.before AND x.n < p.n) < 50 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM p
    """
)
def lru_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return A.lru_hits(_t(spark, d, "events").where("user_id is not null"), "user_id", ["ts", "event_id"], 50)


@_query()
def policy_simulation(spark: SparkSession, d: str) -> DataFrame:
    from vecframe.cache.policies import policy_names

    return A.simulate(_log(spark, d), "query_key", ["ts", "access_id"], policy_names(), [200, 1000], shards=4)
