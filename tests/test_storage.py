"""Collections, streams, files and the command line, end to end."""

from __future__ import annotations

import io
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe import cli
from vecframe.cache.registry import ResultCache
from vecframe.errors import CollectionError, IndexError_, MultipleObjectsReturned, ObjectDoesNotExist, PartitionError, ValidationError
from vecframe.operators.index import IndexSpec
from vecframe.plans import model as M
from vecframe.sources.datasource import register
from vecframe.sources.storage import connect
from vecframe.sources.vectorfile import read_vectors
from vecframe.streaming import jobs


class Doc(M.Model):
    id = M.Int64PrimaryKey()
    title = M.VarCharField(50)
    score = M.FloatField(default=0.0)
    embedding = M.FloatVectorField(4)

    class Meta:
        enable_dynamic_field = True
        cache = True
        indexes = [IndexSpec("title", "STL_SORT"), IndexSpec("embedding", "FLAT")]


ROWS = [dict(title="a", embedding=[1, 0, 0, 0], tag="x"), dict(title="b", embedding=[0, 1, 0, 0], score=0.5), dict(title="c", embedding=[0.9, 0.1, 0, 0], score=0.75)]


@pytest.fixture
def catalog(spark, tmp_path):
    return connect(spark, f"file://{tmp_path}", cache=ResultCache({"SEMANTIC": {"ENABLED": True}}))


@pytest.fixture
def docs(catalog):
    assert catalog.create(Doc) and not catalog.create(Doc)
    c = catalog.collection("doc", Doc)
    c.insert(ROWS)
    return c


def test_reads(docs):
    q = docs.objects
    assert q.count() == 3 and q.filter(score__gt=0.2).count() == 2 and q.filter('tag == "x"').first()["title"] == "a"
    assert q.filter(tag__exists=False).count() == 2
    assert q.get(title="b")["id"] == 2 and "_partition" not in q.first()
    with pytest.raises(ObjectDoesNotExist):
        q.get(title="zz")
    with pytest.raises(MultipleObjectsReturned):
        q.get(score__gte=0.0)
    assert [r["title"] for r in docs.query_raw("score > 0.6", ["title"])] == ["c"]
    assert [r["id"] for r in docs.search_raw([1, 0, 0, 0], "embedding", 2)] == [1, 3]
    assert [r["title"] for r in q.search([1, 0, 0, 0], limit=2, output_fields=["title"]).rows()] == ["a", "c"]
    assert len(q[0:2]) == 2


def test_writes(docs):
    assert docs.upsert([dict(id=1, title="A", embedding=[1, 0, 0, 0]), dict(id=9, title="n", embedding=[0, 0, 0, 1])])["row_count"] == 4
    assert docs.objects.get(id=1)["title"] == "A" and docs.insert([ROWS[0]])["ids"] == [10]
    assert docs.objects.filter(title="n").delete() == 1 and docs.delete_by_ids([2, 77]) == 1 and docs.stats() == {"row_count": 3}
    with pytest.raises(ValidationError):
        docs.objects.delete()
    with pytest.raises(ValidationError):
        docs.insert([])
    with pytest.raises(ValidationError):
        docs.insert([dict(title="x" * 51, embedding=[1, 0, 0, 0])])


def test_instances(docs):
    d = docs.create(title="new", embedding=[0, 0, 1, 0])
    assert d.pk == 4 and not d.is_new
    d.title = "changed"
    docs.save(d)
    other = Doc.from_dict({"id": 4})
    assert docs.refresh(other).title == "changed"
    assert docs.delete(d) == 1 and d.is_new
    with pytest.raises(ObjectDoesNotExist):
        docs.refresh(other)
    with pytest.raises(ValidationError):
        docs.delete(Doc(title="a", embedding=[1, 0, 0, 0]))


def test_frames_get_dense_keys(docs, spark):
    df = spark.range(100).repartition(3).select(F.concat(F.lit("t"), "id").alias("title"), F.array(*[F.lit(1.0)] * 4).alias("embedding"), F.lit(0.5).alias("score"))
    docs.insert(df)
    assert sorted(r.id for r in docs.df().select("id").collect()) == list(range(1, 104))
    assert docs.insert([ROWS[0]])["ids"] == [104]


def test_failed_write_publishes_nothing(docs, spark):
    before = docs.manifest("Strong")
    bad = spark.range(5).select(F.assert_true(F.col("id") < 3).cast("string").alias("title"))
    with pytest.raises(Exception):  # noqa: B017
        docs.insert(bad)
    assert docs.manifest("Strong") == before and docs.objects.count() == 3


def test_conflicting_writers(docs, catalog):
    stale = docs.manifest("Strong")
    docs.insert([ROWS[0]])
    with pytest.raises(CollectionError):
        docs._publish(stale, row_count=0)


def test_partitions(docs):
    docs.create_partition("p1")
    docs.insert(ROWS[:2], "p1")
    assert docs.objects.using_partitions("p1").count() == 2 and docs.partition_stats("p1") == {"row_count": 2} and docs.has_partition("p1")
    assert docs.objects.using_partitions("p1").filter(title="a").delete() == 1 and docs.objects.filter(title="a").count() == 1
    docs.upsert([dict(id=2, title="B", embedding=[0, 1, 0, 0])])
    assert docs.partition_stats("p1") == {"row_count": 1}
    docs.drop_partition("p1")
    assert docs.objects.count() == 3
    for bad in (lambda: docs.insert(ROWS, "zz"), lambda: docs.df(["zz"]), lambda: docs.drop_partition("_default")):
        with pytest.raises(PartitionError):
            bad()


def test_partition_key(catalog, spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.StringType())])
    catalog.create(schema, "keyed", "id", partition_key_field="k", num_partitions=4)
    c = catalog.collection("keyed")
    c.insert(spark.range(40).select("id", (F.col("id") % 10).cast("string").alias("k")))
    assert len(c.partitions()) > 2 and c.objects.count() == 40


def test_indexes(docs, spark):
    docs.insert(spark.range(400).select(F.concat(F.lit("t"), "id").alias("title"), F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(4)]).alias("embedding"), F.lit(0.5).alias("score")))
    want = [r["id"] for r in docs.objects.search([1, 0.2, 0, 0], limit=5, exact=True).rows()]
    for kind, params in (("IVF_FLAT", {"nlist": 8}), ("HNSW", {}), ("SCANN", {"nlist": 8, "m": 2}), ("AUTOINDEX", {})):
        docs.create_index(IndexSpec("embedding", kind, params=params))
        assert [r["id"] for r in docs.objects.search([1, 0.2, 0, 0], limit=5, nprobe=99).rows()] == want, kind
    filtered = docs.objects.filter(title__like="t1%").search([1, 0.2, 0, 0], limit=5, nprobe=99, output_fields=["title"]).rows()
    assert all(r["title"].startswith("t1") for r in filtered) and len(filtered) == 5
    assert docs.describe_index("embedding")["index_type"] == "AUTOINDEX" and docs.list_indexes() == ["embedding", "title"]
    docs.drop_index("title")
    for bad in (lambda: docs.drop_index("title"), lambda: docs.describe_index("x"), lambda: docs.create_index(IndexSpec("x"))):
        with pytest.raises(IndexError_):
            bad()


def test_consistency(catalog, spark):
    catalog.create(Doc)
    reader, writer = catalog.collection("doc", Doc), connect(spark, catalog.root.rsplit("/", 1)[0]).collection("doc", Doc)
    assert reader.objects.count() == 0
    writer.insert(ROWS)
    assert reader.objects.consistency("Eventually").count() == 0
    assert reader.objects.consistency("Strong").count() == 3


def test_result_cache(docs):
    q = docs.objects.cache().filter(score__gt=0.2)
    assert q.rows() == q.rows()
    report = docs.cache.report()
    assert report["lookups"] == 2 and report["hits"] == 1
    docs.insert([dict(title="z", embedding=[1, 1, 0, 0], score=0.9)])
    assert len(q.rows()) == 3
    s = docs.objects.cache()
    assert [r["id"] for r in s.search([1, 0, 0, 0], limit=2).rows()] == [1, 3]
    near = s.search([1, 0.001, 0, 0], limit=2).rows()
    assert [r["id"] for r in near] == [1, 3] and docs.cache.report()["semantic_hits"] == 1
    assert q.cache_key() != docs.objects.cache_key()
    docs.objects.no_cache().rows()
    strong = docs.cache.report()["lookups"]
    docs.objects.cache().consistency("Strong").rows()
    assert docs.cache.report()["lookups"] == strong


def test_warm_and_clear(docs):
    assert docs.cache_warm([[1, 0, 0, 0]], [docs.objects.filter(score__gt=0.2)]) == (2, [])
    assert docs.objects.cache().search([1, 0, 0, 0], limit=10).rows() and docs.cache_stats()["hits"] == 1
    docs.cache_clear()
    docs.objects.cache().search([1, 0, 0, 0], limit=10).rows()
    assert docs.cache_stats()["hits"] == 1


def test_residency(docs):
    assert docs.load_state() == "NotLoad"
    docs.load()
    assert docs.load_state() == "Loaded" and docs.objects.count() == 3
    docs.release()
    docs.flush()
    assert docs.load_state() == "NotLoad"


def test_catalog(catalog):
    catalog.create(Doc)
    catalog.create_alias("latest", "doc")
    assert catalog.collection("latest", Doc).name == "doc" and catalog.list_aliases() == {"latest": "doc"}
    with pytest.raises(CollectionError):
        catalog.create_alias("latest", "doc")
    catalog.rename("doc", "papers")
    catalog.alter_alias("latest", "papers")
    assert catalog.list() == ["papers"] and catalog.describe("latest")["row_count"] == 0
    catalog.drop_alias("latest")
    assert catalog.drop("papers") and not catalog.drop("papers")
    with pytest.raises(CollectionError):
        catalog.collection("papers")


def test_access(catalog):
    catalog.create_user("u", "secret")
    catalog.update_password("u", "secret", "other")
    with pytest.raises(ValidationError):
        catalog.update_password("u", "secret", "x")
    catalog.create_role("r")
    catalog.grant_role("u", "r")
    catalog.grant_privilege("r", "Collection", "doc", "Search")
    assert catalog.describe_user("u")["roles"] == ["r"] and catalog.describe_role("r")[0]["privilege"] == "Search"
    catalog.revoke_privilege("r", "Collection", "doc", "Search")
    assert catalog.describe_role("r") == [] and catalog.list_roles() == ["r"]
    catalog.drop_role("r")
    assert catalog.describe_user("u")["roles"] == []
    catalog.drop_user("u")
    assert catalog.list_users() == []


def test_named_format(docs, spark, tmp_path):
    register(spark)
    df = spark.read.format("vecframe").load(f"file://{tmp_path}/default/doc")
    assert sorted(r.title for r in df.collect()) == ["a", "b", "c"]


def test_vector_file(spark, tmp_path):
    (tmp_path / "a.json").write_text("[[1, 2], [3, 4]]")
    (tmp_path / "b.json").write_text('{"vectors": [[5, 6]], "limit": 3, "ttl": 9}')
    assert [list(r.vector) for r in read_vectors(spark, str(tmp_path / "a.json")).orderBy("position").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    r = read_vectors(spark, str(tmp_path / "b.json")).first()
    assert (list(r.vector), r.limit, r.ttl) == ([5.0, 6.0], 3, 9.0)


def test_command_line(docs, spark, tmp_path):
    root = f"file://{tmp_path}"

    def run(*args):
        out = io.StringIO()
        return cli.main(["--root", root, *args], spark, out), out.getvalue()

    assert json.loads(run("stats", "doc", "--json")[1])["row_count"] == 3
    assert json.loads(run("query", "doc", "--filter", "score > 0.6")[1])["title"] == "c"
    assert run("sync", "tests.test_storage")[1].startswith("doc exists")
    (tmp_path / "v.json").write_text("[[1, 0, 0, 0]]")
    assert "1 warmed" in run("cache-warm", "doc", str(tmp_path / "v.json"))[1]
    assert run("drop", "doc")[0] == 1 and "dropped" in run("drop", "doc", "--yes")[1]
    assert run("query", "doc")[0] == 2 and run("cache-stats")[0] == 0


# --- streams


def _in_order(folder):
    """A stream takes files by their times."""
    for i, f in enumerate(sorted(folder.glob("*.parquet"))):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))


@pytest.fixture
def trace(spark, tmp_path):
    rows = [(i, i * 7 % 11, 1_700_000_000 + i * 20, i % 3 > 0) for i in range(60)]
    df = spark.createDataFrame(rows, "n long, k long, s long, hit boolean").select("n", "k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "hit")
    schema, path = jobs.replay_table(df, str(tmp_path / "trace"), 3, "n")
    _in_order(tmp_path / "trace")
    return df, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_upserts(docs, spark, tmp_path):
    rows = [(i % 5 + 1, f"v{i}", [1.0] * 4, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, title string, embedding array<float>, score float")
    schema, path = jobs.replay_table(df, str(tmp_path / "in"), 2, "score")
    _in_order(tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    for _ in range(2):
        q = jobs.upsert_into(stream, docs, str(tmp_path / "cp"), [F.desc("score")], available_now=True)
        q.awaitTermination()
    assert docs.objects.consistency("Strong").count() == 5 and docs.objects.get(id=2)["title"] == "v11"


def test_stream_hit_rate(trace, spark, tmp_path):
    df, stream = trace
    jobs.run_to_end(jobs.sliding_hit_rate(stream, "ts", F.col("hit"), "300 seconds", "60 seconds"), "rates", str(tmp_path / "cp"), "complete")
    got = spark.table("rates").agg(F.sum("lookups"), F.sum("hits")).first()
    assert got[0] == 60 * 5 and got[1] == 40 * 5


def test_stream_expiry(trace, spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    df, stream = trace
    jobs.run_to_end(jobs.entry_states(stream, "k", "ts", 300, 60, "1 hour"), "states", str(tmp_path / "cp"))
    got = sorted((r.key, r.at_ms, r.state) for r in spark.table("states").collect())
    want, written = [], {}
    for r in df.orderBy("n").collect():
        at, k = int(r.ts.replace(tzinfo=__import__("datetime").timezone.utc).timestamp() * 1000), str(r.k)
        age = at - written[k] if k in written else None
        state = "miss" if age is None or age >= 360_000 else "hit" if age < 300_000 else "stale"
        if state == "miss":
            written[k] = at
        want.append((k, at, state))
    assert got == sorted(want)


def test_stream_policy(trace, spark, tmp_path):
    from vecframe.cache.policies import replay

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    df, stream = trace
    jobs.run_to_end(jobs.trace_through(stream, "k", "ts", "lru", 6, 1), "hits", str(tmp_path / "cp"))
    got = spark.table("hits").agg(F.sum("accesses"), F.sum("hits")).first()
    assert tuple(got) == (60, replay("lru", 6, [str(r.k) for r in df.orderBy("n").collect()]))


def test_a_model_turns_caching_on_and_counts_are_cached(docs, catalog):
    q = docs.objects.filter(score__gte=0.0)
    before = catalog.cache.report().get("hits", 0)
    assert q.count() == q.count() == 3 and len(q.rows()) == len(q.rows()) == 3
    assert catalog.cache.report().get("hits", 0) == before + 2
    assert q.no_cache().count() == 3 and catalog.cache.report().get("hits", 0) == before + 2
    docs.insert([dict(title="d", embedding=[0, 0, 1, 0])])
    assert q.count() == 4


def test_a_cached_batch_answers_every_query(docs):
    q = docs.objects.search([[1, 0, 0, 0], [0, 1, 0, 0]], limit=2)
    first, again = q.rows(), q.rows()
    assert first == again and sorted((r["query_id"], r["rank"]) for r in first) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_frames_are_never_cut(spark):
    from vecframe.plans.spec import DEFAULT_LIMIT, Query

    q = Query.over(spark.range(DEFAULT_LIMIT + 10), "id")
    assert q.to_df().count() == DEFAULT_LIMIT + 10 and len(q.rows()) == DEFAULT_LIMIT


def test_binary_vectors_are_searched_by_the_builder(spark):
    from vecframe.errors import SearchError
    from vecframe.plans.spec import Query

    rows = [(i, bytearray([i] * 8), f"t{i}") for i in range(8)] + [(98, None, "n"), (99, bytearray(b"xy"), "s")]
    q = Query.over(spark.createDataFrame(rows, "id int, h binary, title string"), "id", ("h",))
    assert [(r["id"], r["score"]) for r in q.search(bytes([3] * 8), limit=3).rows()] == [(3, 0.0), (1, 8.0), (2, 8.0)]
    assert [r["title"] for r in q.filter(id__gt=3).search(bytes([3] * 8), limit=1, output_fields=["title"]).rows()] == ["t7"]
    assert q.search(bytes([3] * 8), limit=1, metric_type="JACCARD").rows()[0]["score"] == 0.0
    got = q.search([bytes([0] * 8), bytes([7] * 8)], limit=2).rows()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == [(0, 1, 0), (0, 2, 1), (1, 1, 7), (1, 2, 3)]
    with pytest.raises(SearchError):
        q.search([1.0, 2.0], limit=1).rows()


def test_renaming_takes_aliases_along(docs, catalog):
    catalog.create_alias("now", "doc")
    catalog.rename("doc", "paper")
    assert catalog.describe_alias("now") == {"alias": "now", "collection": "paper", "database": "default"}
    assert catalog.collection("now", Doc).objects.count() == 3


def test_writes_touch_only_parts_that_hold_a_key(docs, spark):
    docs.create_partition("other")
    docs.insert([dict(title="o", embedding=[0, 0, 0, 1])], partition="other")
    kept = {p["path"] for p in docs.manifest("Strong")["parts"] if p["partition"] == "other"}
    assert docs.delete_by_ids([1]) == 1 and docs.objects.filter(title="b").delete() == 1 and docs.delete_by_ids([777]) == 0
    assert kept <= {p["path"] for p in docs.manifest("Strong")["parts"]} and docs.stats() == {"row_count": 2}
    twice = spark.createDataFrame([(3, "x", 0.0, [1.0, 0.0, 0.0, 0.0], 1), (3, "y", 0.0, [1.0, 0.0, 0.0, 0.0], 2)], "id long, title string, score float, embedding array<float>, n int")
    with pytest.raises(ValidationError):
        docs.upsert(twice.drop("n"))
    assert [len(r["ids"]) for r in docs.bulk_create([ROWS[0]] * 5, batch_size=2)] == [2, 2, 1]


def test_an_unfiltered_index_search_reads_no_rows_of_the_collection(catalog, spark):
    import numpy as np

    x = np.random.default_rng(2).standard_normal((60, 4))
    catalog.create(T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.FloatType()))]), "ivf", "id")
    c = catalog.collection("ivf")
    c.insert(spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<float>"))
    c.create_index(IndexSpec("v", "IVF_FLAT", params={"nlist": 6}), build=True)
    q = c.objects
    plain = q.search(x[0].tolist(), "v", 3).to_df()._jdf.queryExecution().optimizedPlan().toString()
    some = q.filter(id__gt=5).search(x[0].tolist(), "v", 3).to_df()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plain and "Join" in some
    assert q.search(x[0].tolist(), "v", 3).rows()[0]["id"] == 0
