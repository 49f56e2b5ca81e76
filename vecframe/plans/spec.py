"""The query builder: an immutable specification that becomes a DataFrame when it is asked for rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.errors import MultipleObjectsReturned, ObjectDoesNotExist, SearchError, ValidationError
from vecframe.functions import predicates as P
from vecframe.functions.metrics import metric
from vecframe.operators import index as I
from vecframe.operators import search as S

if TYPE_CHECKING:
    from vecframe.sources.storage import Collection

#: Rows that a read without a limit collects; a DataFrame is never cut.
DEFAULT_LIMIT = 16_384
CONSISTENCY = ("Strong", "Bounded", "Session", "Eventually")


@dataclass(frozen=True)
class SearchRequest:
    """One nearest-vector search."""

    data: Any
    anns_field: str | None = None
    limit: int = 10
    metric_type: str | None = None
    params: tuple[tuple[str, Any], ...] = ()
    expr: str = ""
    output_fields: tuple[str, ...] | None = None


@dataclass(frozen=True)
class HybridRequest:
    """Several searches and how they are fused: ``("rrf", constant)`` or ``("weighted", weights)``."""

    requests: tuple[SearchRequest, ...]
    ranker: tuple[str, Any] = ("rrf", 60)
    limit: int = 10
    output_fields: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Spec:
    conditions: tuple[Any, ...] = ()
    limit: int | None = None
    offset: int = 0
    fields: tuple[str, ...] | None = None
    as_dicts: bool = False
    partitions: tuple[str, ...] = ()
    consistency: str | None = None
    empty: bool = False
    search: SearchRequest | None = None
    hybrid: HybridRequest | None = None
    cache: tuple[tuple[str, Any], ...] = ()

    def condition(self) -> P.All:
        return P.All(self.conditions)

    def fingerprint(self) -> str:
        """A digest of everything that decides the result."""
        parts = (P.to_text(self.condition()), self.limit, self.offset, self.fields, tuple(sorted(self.partitions)), self.consistency, self.empty, self.search, self.hybrid)
        return hashlib.sha1(repr(parts).encode()).hexdigest()[:24]


def _is_batch(data: Any) -> bool:
    return isinstance(data, list | tuple) and bool(data) and not isinstance(data[0], int | float)


@dataclass(frozen=True)
class Query:
    """A lazy query over a collection or any DataFrame; every verb returns a new one.

    ``key`` orders ties; ``partition_column`` is what :meth:`using_partitions` restricts.
    """

    source: Callable[[Spec], DataFrame]
    key: str
    vector_fields: tuple[str, ...] = ()
    partition_column: str | None = None
    collection: Collection | None = None
    default_metric: str = "COSINE"
    spec: Spec = field(default_factory=Spec)

    @classmethod
    def over(cls, df: DataFrame, key: str, vectors: Sequence[str] = (), partition_column: str | None = None) -> Query:
        return cls(lambda _spec: df, key, tuple(vectors), partition_column)

    def _with(self, **changes: Any) -> Query:
        return replace(self, spec=replace(self.spec, **changes))

    # --- verbs

    def filter(self, expr: str | None = None, **given: Any) -> Query:
        """Rows for which the text and all lookups hold; repeated lookups add up."""
        more = ((P.parse(expr),) if expr else ()) + ((P.lookups(**given),) if given else ())
        return self._with(conditions=self.spec.conditions + more)

    def exclude(self, **given: Any) -> Query:
        return self._with(conditions=self.spec.conditions + (P.excluded(**given),))

    def limit(self, n: int) -> Query:
        if n < 0:
            raise ValidationError("a limit is not negative")
        return self._with(limit=n)

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    def only(self, *names: str) -> Query:
        return self._with(fields=names or None)

    def values(self, *names: str) -> Query:
        return self._with(fields=names or None, as_dicts=True)

    def using_partitions(self, *names: str) -> Query:
        return self._with(partitions=names)

    def consistency(self, level: str) -> Query:
        if level not in CONSISTENCY:
            raise ValidationError(f"no consistency level {level!r}")
        return self._with(consistency=level)

    def all(self) -> Query:
        return self._with()

    def none(self) -> Query:
        """No rows, whatever is chained after it."""
        return self._with(empty=True)

    def cache(self, **options: Any) -> Query:
        return self._with(cache=tuple(sorted({**dict(self.spec.cache), "enabled": True, **options}.items(), key=lambda kv: kv[0])))

    def no_cache(self) -> Query:
        return self._with(cache=(("enabled", False),))

    def refresh_cache(self) -> Query:
        return self.cache(refresh=True)

    def cache_key(self) -> str:
        version = self.collection.version() if self.collection else 0
        name = self.collection.name if self.collection else "frame"
        op = "h" if self.spec.hybrid else "s" if self.spec.search else "q"
        return f"vf:default:{name}:v{version}:{op}:{self.spec.fingerprint()}"

    def search(self, vector: Any, vector_field: str | None = None, limit: int = 10, metric_type: str | None = None, search_params: dict[str, Any] | None = None, output_fields: Sequence[str] | None = None, **more: Any) -> Query:
        """The ``limit`` most similar rows to a vector, or to each of a list of vectors; the filter applies first.

        Offset and row limit are for reads only and are refused together with a search.
        """
        params = dict(search_params or {}) | more
        metric_type = metric_type or params.pop("metric_type", None)
        return self._with(search=SearchRequest(vector, vector_field, limit, metric_type, tuple(sorted(params.items())), "", tuple(output_fields) if output_fields else None))

    def hybrid_search(self, requests: Sequence[SearchRequest | dict[str, Any]], ranker: tuple[str, Any] = ("rrf", 60), limit: int = 10, output_fields: Sequence[str] | None = None) -> Query:
        """Several searches fused into one ranking; the query's filter applies to every one of them."""
        legs = []
        for r in requests:
            if isinstance(r, dict):
                param = dict(r.get("param") or {})
                r = SearchRequest(r["data"], r.get("anns_field"), r.get("limit", limit), param.pop("metric_type", None), tuple(sorted(param.items())), r.get("expr") or "")
            legs.append(r)
        if not legs:
            raise SearchError("a hybrid search needs a request")
        return self._with(hybrid=HybridRequest(tuple(legs), ranker, limit, tuple(output_fields) if output_fields else None))

    # --- to DataFrames

    def base(self) -> DataFrame:
        """The rows that filter and partitions leave."""
        df = self.source(self.spec)
        if self.spec.empty:
            return df.limit(0)
        if self.spec.partitions:
            if not self.partition_column:
                raise ValidationError("this source has no partitions")
            df = df.where(F.col(self.partition_column).isin(*self.spec.partitions))
        if self.spec.conditions:
            df = df.where(P.to_column(self.spec.condition(), df.schema))
        return df

    def to_df(self) -> DataFrame:
        """The result as a lazy DataFrame; all of it, unless there is a limit."""
        if self.spec.hybrid:
            return self._hybrid_df(self.spec.hybrid)
        if self.spec.search:
            return self._search_df(self.spec.search)
        df = self.base()
        df = df.select(*self.spec.fields) if self.spec.fields else self._visible(df)
        if self.spec.offset:
            df = df.offset(self.spec.offset)
        return df if self.spec.limit is None else df.limit(self.spec.limit)

    def ordered(self, *columns: str | Column) -> DataFrame:
        """The rows in an order, limit and offset taken after it (a take-ordered, not a full sort)."""
        df = self.base().orderBy(*(columns or (self.key,)))
        if self.spec.offset:
            df = df.offset(self.spec.offset)
        df = df if self.spec.limit is None else df.limit(self.spec.limit)
        return df.select(*self.spec.fields) if self.spec.fields else self._visible(df)

    def _visible(self, df: DataFrame) -> DataFrame:
        """Without the partition column of a collection, which is no field."""
        return df.drop(self.partition_column) if self.collection is not None and self.partition_column else df

    def _vector_field(self, named: str | None) -> str:
        if named:
            return named
        if len(self.vector_fields) != 1:
            raise SearchError(f"name one of the vector fields {list(self.vector_fields)}")
        return self.vector_fields[0]

    def _refuse_paging(self) -> None:
        if self.spec.limit is not None or self.spec.offset:
            raise SearchError("a search has its own limit; limit() and offset() are for reads")

    def _search_df(self, r: SearchRequest) -> DataFrame:
        self._refuse_paging()
        name, vector = (r.metric_type or self.default_metric), self._vector_field(r.anns_field)
        base = self.base()
        if r.expr:
            base = base.where(P.to_column(P.parse(r.expr), base.schema))
        extra = [c for c in (r.output_fields or self.spec.fields or ()) if c != self.key]
        if isinstance(r.data, dict):
            hits = S.sparse_top_k(base, r.data, r.limit, self.key, vector)
            return S.hydrate(hits, base, self.key, extra) if extra else hits
        if isinstance(base.schema[vector].dataType, T.BinaryType):
            return self._binary_df(r, base, vector, extra)
        if _is_batch(r.data):
            spark = base.sparkSession
            queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.data)], "query_id int, query_vector array<double>")
            hits = S.batch_top_k(base, queries, r.limit, self.key, vector, "query_id", "query_vector", name)
            return S.hydrate(hits, base, self.key, extra) if extra else hits
        if self.collection is not None and (index := self.collection.usable_index(vector, name, dict(r.params))) is not None:
            restricted = self.spec.conditions or self.spec.partitions or self.spec.empty or r.expr
            hits = index.search(base if restricted else None, self.key, vector, r.data, r.limit, name, dict(r.params))
        else:
            hits = S.top_k(base, self.key, vector, r.data, r.limit, name)
        if not extra:
            return hits
        order = S.ordered("score", metric(name).higher_is_better)
        return S.hydrate(hits, base, self.key, extra).orderBy(order, self.key)

    def _binary_df(self, r: SearchRequest, base: DataFrame, vector: str, extra: list[str]) -> DataFrame:
        """Hamming (the default) or Jaccard distances to a binary vector, or to each of a list of them."""
        name = (r.metric_type or "HAMMING").upper()
        if isinstance(r.data, bytes | bytearray):
            hits = I.binary_top_k(base, self.key, vector, bytes(r.data), r.limit, name)
            return S.hydrate(hits, base, self.key, extra).orderBy("score", self.key) if extra else hits
        if not _is_batch(r.data) or not all(isinstance(v, bytes | bytearray) for v in r.data):
            raise SearchError("a binary field is searched with bytes")
        hits = I.binary_batch_top_k(base, [bytes(v) for v in r.data], r.limit, self.key, vector, name)
        return S.hydrate(hits, base, self.key, extra) if extra else hits

    def _hybrid_df(self, h: HybridRequest) -> DataFrame:
        self._refuse_paging()
        legs, named = [], []
        for r in h.requests:
            single = replace(self, spec=replace(self.spec, hybrid=None, search=replace(r, output_fields=None), fields=None))
            name = r.metric_type or self.default_metric
            hits = single._search_df(single.spec.search)
            legs.append(S.leg(hits, self.key, isinstance(r.data, dict) or metric(name).higher_is_better, len(legs), r.limit))
            named.append((hits, "IP" if isinstance(r.data, dict) else name))
        kind, value = h.ranker
        if kind == "rrf":
            fused = S.reciprocal_rank_fusion(legs, self.key, h.limit, int(value or 60))
        elif kind == "weighted":
            if len(value) != len(named):
                raise SearchError("as many weights as requests are needed")
            fused = S.weighted_fusion([(a, b, w) for (a, b), w in zip(named, value, strict=True)], self.key, h.limit)
        else:
            raise SearchError(f"no ranker {kind!r}")
        extra = [c for c in (h.output_fields or self.spec.fields or ()) if c != self.key]
        return S.hydrate(fused, self.base(), self.key, extra).orderBy(F.desc("score"), self.key) if extra else fused

    # --- results

    def __iter__(self) -> Iterator[Any]:
        return iter(self.rows())

    def rows(self) -> list[dict[str, Any]]:
        """The result, collected (a read without a limit has at most ``DEFAULT_LIMIT`` rows)."""
        if self.collection is not None and self.collection.cache is not None:
            return self.collection.cached_rows(self)
        return self.fetched()

    def fetched(self) -> list[dict[str, Any]]:
        """The result, collected past the cache."""
        df = self.to_df()
        if self.spec.limit is None and not self.spec.search and not self.spec.hybrid:
            df = df.limit(DEFAULT_LIMIT)
        return [r.asDict(recursive=True) for r in df.collect()]

    def __len__(self) -> int:
        return len(self.rows())

    def __bool__(self) -> bool:
        return self.exists()

    def __getitem__(self, at: int | slice) -> Any:
        if isinstance(at, slice):
            if (at.start or 0) < 0 or (at.stop is not None and at.stop < 0) or at.step not in (None, 1):
                raise ValidationError("slices go forward from the start")
            start = at.start or 0
            q = self.offset(self.spec.offset + start)
            return q.rows() if at.stop is None else q.limit(max(0, at.stop - start)).rows()
        return self.rows()[at]

    def get(self, **given: Any) -> dict[str, Any]:
        rows = self.filter(**given).limit(2).rows() if given else self.limit(2).rows()
        if not rows:
            raise ObjectDoesNotExist(str(given))
        if len(rows) > 1:
            raise MultipleObjectsReturned(str(given))
        return rows[0]

    def get_or_none(self, **given: Any) -> dict[str, Any] | None:
        try:
            return self.get(**given)
        except ObjectDoesNotExist:
            return None

    def first(self) -> dict[str, Any] | None:
        """The row of the smallest key."""
        got = self.limit(1).ordered().collect()
        return got[0].asDict(recursive=True) if got else None

    def count_df(self) -> DataFrame:
        return self.base().agg(F.count("*").alias("count"))

    def count(self) -> int:
        """Rows that filter and partitions leave; limit and offset do not matter."""
        if self.collection is not None and self.collection.cache is not None:
            return self.collection.cached_count(self)
        return self.counted()

    def counted(self) -> int:
        return int(self.count_df().first()[0])

    def exists_df(self) -> DataFrame:
        return self.base().select(F.lit(1).alias("one")).limit(1).agg((F.count("*") > 0).alias("found"))

    def exists(self) -> bool:
        return not self.base().select(F.lit(1)).isEmpty()

    def delete(self) -> int:
        """Delete what the filter leaves, in all named partitions; an empty filter is refused."""
        if self.collection is None:
            raise ValidationError("this source cannot be written")
        if not self.spec.conditions:
            raise ValidationError("a delete needs a filter")
        return self.collection.delete_where(self.spec)
