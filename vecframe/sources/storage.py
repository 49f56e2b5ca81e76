"""Collections: versioned tables of parquet files, written as snapshots and published by one atomic rename.

``<root>/<database>/<collection>/``: ``data/snap=<n>-<token>/_p=<partition>/*.parquet``, ``manifest-<n>.json`` (schema,
parts, indexes, counts) and ``CURRENT``, which names the manifest in force. Readers pin a manifest when they plan. A
failed write publishes nothing.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import secrets
import time
import uuid
from collections.abc import Iterable, Sequence
from typing import TYPE_CHECKING, Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.errors import CollectionError, IndexError_, ObjectDoesNotExist, PartitionError, ValidationError
from vecframe.functions import predicates as P
from vecframe.operators import index as I
from vecframe.operators import mutate
from vecframe.plans.model import Model, encode_rows
from vecframe.plans.spec import Query, Spec

if TYPE_CHECKING:
    from vecframe.cache.registry import ResultCache

DEFAULT_PARTITION = "_default"
#: Seconds that a manifest in memory may serve reads of these consistency levels.
STALENESS = {"Bounded": 5.0, "Eventually": 60.0}
_PARTITION = "_partition"


class Files:
    """Small files through Hadoop's file systems, so that any scheme works."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple[Any, Any]:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return bool(fs.exists(p))

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, new: bool = False) -> bool:
        """Atomic by rename; with ``new`` an existing file is kept and False returned."""
        fs, p = self._at(path)
        if new and fs.exists(p):
            return False
        tmp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not new:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
            rename = self.jvm.org.apache.hadoop.fs.Options.Rename
            options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
            options[0] = rename.OVERWRITE
            context.rename(tmp, p, options)
            return True
        if fs.rename(tmp, p):
            return True
        fs.delete(tmp, False)
        return False

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(str(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def move(self, a: str, b: str) -> bool:
        fs, p = self._at(a)
        return bool(fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(b)))

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Catalog:
    """The collections under a root folder, their aliases, and who may do what."""

    def __init__(self, spark: SparkSession, root: str, database: str = "default", cache: ResultCache | None = None) -> None:
        self.spark, self.database, self.cache = spark, database, cache
        self.root = f"{root.rstrip('/')}/{database}"
        self.files = Files(spark)
        self._open: dict[str, Collection] = {}

    # --- collections

    def create(self, model: type[Model] | T.StructType, name: str | None = None, key: str | None = None, drop_existing: bool = False, **options: Any) -> bool:
        """Make a collection of a model or a schema; False if there is one already."""
        if isinstance(model, T.StructType):
            if not name or not key:
                raise CollectionError("a schema needs a name and a key")
            schema, indexes, opts = model, [], dict(options)
        else:
            schema, key = model.schema(), model.key_name()
            name = name or model.options.collection_name
            indexes = [i.to_dict() for i in model.options.indexes]
            opts = {"description": model.options.description, "num_partitions": model.options.num_partitions, "shards_num": model.options.shards_num, "partition_key_field": model.options.partition_key_field, "consistency_level": model.options.consistency_level} | options
        if self.has(name):
            if not drop_existing:
                return False
            self.drop(name)
        manifest = {"version": 0, "schema": schema.json(), "key": key, "parts": [], "partitions": [DEFAULT_PARTITION], "indexes": {i["field_name"]: i for i in indexes}, "row_count": 0, "next_id": 1, "options": opts}
        path = f"{self.root}/{name}"
        self.files.write(f"{path}/manifest-0.json", json.dumps(manifest))
        self.files.write(f"{path}/CURRENT", "0")
        return True

    def collection(self, name: str, model: type[Model] | None = None) -> Collection:
        name = self.resolve(name)
        if not self.has(name):
            raise CollectionError(f"no collection {name!r}")
        if name not in self._open:
            self._open[name] = Collection(self, name, model)
        if model is not None:
            self._open[name].model = model
        return self._open[name]

    def has(self, name: str) -> bool:
        return self.files.exists(f"{self.root}/{name}/CURRENT")

    def list(self) -> list[str]:
        return [n for n in self.files.list(self.root) if not n.startswith("_") and self.has(n)]

    def drop(self, name: str) -> bool:
        found = self.has(name)
        if found:
            self.files.delete(f"{self.root}/{name}")
            self._open.pop(name, None)
            if self.cache is not None:
                self.cache.clear(name)
        return found

    def rename(self, name: str, to: str) -> None:
        if self.has(to):
            raise CollectionError(f"{to!r} exists")
        if not self.files.move(f"{self.root}/{name}", f"{self.root}/{to}"):
            raise CollectionError(f"cannot rename {name!r}")
        self._open.pop(name, None)
        aliases = self._map("aliases")
        if name in aliases.values():
            self._save("aliases", {a: to if n == name else n for a, n in aliases.items()})
        if self.cache is not None:
            self.cache.clear(name)

    def describe(self, name: str) -> dict[str, Any]:
        m = self.collection(name).manifest("Strong")
        return {"name": self.resolve(name), "key": m["key"], "fields": json.loads(m["schema"])["fields"], "indexes": list(m["indexes"].values()), "partitions": m["partitions"], "row_count": m["row_count"], "version": m["version"], "options": m["options"]}

    # --- aliases

    def _map(self, what: str) -> dict[str, Any]:
        return json.loads(self.files.read(f"{self.root}/_{what}.json") or "{}")

    def _save(self, what: str, value: dict[str, Any]) -> None:
        self.files.write(f"{self.root}/_{what}.json", json.dumps(value))

    def resolve(self, name: str) -> str:
        return self._map("aliases").get(name, name)

    def create_alias(self, alias: str, name: str) -> None:
        m = self._map("aliases")
        if alias in m or self.has(alias):
            raise CollectionError(f"{alias!r} exists")
        self._save("aliases", m | {alias: name})

    def alter_alias(self, alias: str, name: str) -> None:
        m = self._map("aliases")
        if alias not in m:
            raise CollectionError(f"no alias {alias!r}")
        self._save("aliases", m | {alias: name})

    def drop_alias(self, alias: str) -> None:
        self._save("aliases", {k: v for k, v in self._map("aliases").items() if k != alias})

    def describe_alias(self, alias: str) -> dict[str, str]:
        m = self._map("aliases")
        if alias not in m:
            raise CollectionError(f"no alias {alias!r}")
        return {"alias": alias, "collection": m[alias], "database": self.database}

    def list_aliases(self, name: str | None = None) -> dict[str, str]:
        return {k: v for k, v in self._map("aliases").items() if name in (None, v)}

    # --- users, roles, privileges: a record; enforcing it is the storage's matter

    def create_user(self, user: str, password: str) -> None:
        access = self._map("access")
        if user in access.setdefault("users", {}):
            raise CollectionError(f"user {user!r} exists")
        access["users"][user] = {"password": _hashed(password), "roles": []}
        self._save("access", access)

    def update_password(self, user: str, old: str, new: str) -> None:
        access = self._map("access")
        if not _matches(old, access.get("users", {}).get(user, {}).get("password", "")):
            raise ValidationError("wrong user or password")
        access["users"][user]["password"] = _hashed(new)
        self._save("access", access)

    def drop_user(self, user: str) -> None:
        access = self._map("access")
        access.get("users", {}).pop(user, None)
        self._save("access", access)

    def list_users(self) -> list[str]:
        return sorted(self._map("access").get("users", {}))

    def describe_user(self, user: str) -> dict[str, Any]:
        u = self._map("access").get("users", {}).get(user)
        if u is None:
            raise ObjectDoesNotExist(user)
        return {"user": user, "roles": u["roles"]}

    def create_role(self, role: str) -> None:
        access = self._map("access")
        access.setdefault("roles", {}).setdefault(role, [])
        self._save("access", access)

    def drop_role(self, role: str) -> None:
        access = self._map("access")
        access.get("roles", {}).pop(role, None)
        for u in access.get("users", {}).values():
            u["roles"] = [r for r in u["roles"] if r != role]
        self._save("access", access)

    def list_roles(self) -> list[str]:
        return sorted(self._map("access").get("roles", {}))

    def describe_role(self, role: str) -> list[dict[str, str]]:
        return self._map("access").get("roles", {}).get(role, [])

    def grant_role(self, user: str, role: str) -> None:
        access = self._map("access")
        roles = access["users"][user]["roles"]
        access["users"][user]["roles"] = sorted({*roles, role})
        self._save("access", access)

    def revoke_role(self, user: str, role: str) -> None:
        access = self._map("access")
        access["users"][user]["roles"] = [r for r in access["users"][user]["roles"] if r != role]
        self._save("access", access)

    def grant_privilege(self, role: str, object_type: str, object_name: str, privilege: str) -> None:
        access = self._map("access")
        entry = {"object_type": object_type, "object_name": object_name, "privilege": privilege}
        held = access.setdefault("roles", {}).setdefault(role, [])
        if entry not in held:
            held.append(entry)
        self._save("access", access)

    def revoke_privilege(self, role: str, object_type: str, object_name: str, privilege: str) -> None:
        access = self._map("access")
        entry = {"object_type": object_type, "object_name": object_name, "privilege": privilege}
        access["roles"][role] = [e for e in access.get("roles", {}).get(role, []) if e != entry]
        self._save("access", access)


def _hashed(password: str, salt: str | None = None) -> str:
    salt = salt or secrets.token_hex(8)
    return salt + "$" + hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt), 100_000).hex()


def _matches(password: str, stored: str) -> bool:
    return bool(stored) and secrets.compare_digest(_hashed(password, stored.split("$")[0]), stored)


class Collection:
    """One collection: reads through :attr:`objects`, writes as new snapshots."""

    def __init__(self, catalog: Catalog, name: str, model: type[Model] | None = None) -> None:
        self.catalog, self.name, self.model = catalog, name, model
        self.spark, self.files, self.cache = catalog.spark, catalog.files, catalog.cache
        self.path = f"{catalog.root}/{name}"
        self._manifest: dict[str, Any] | None = None
        self._read_at = 0.0
        self._written = -1
        self._loaded: dict[tuple[str, ...], DataFrame] = {}

    # --- manifests

    def manifest(self, consistency: str | None = None) -> dict[str, Any]:
        """Strong: the one in force. Session: not older than this reader's last write. Others: from memory for a while."""
        age = time.monotonic() - self._read_at
        held = self._manifest
        level = consistency or (held or {}).get("options", {}).get("consistency_level") or "Bounded"
        if held is not None and ((level in STALENESS and age < STALENESS[level] and held["version"] >= self._written) or (level == "Session" and held["version"] >= self._written >= 0)):
            return held
        current = self.files.read(f"{self.path}/CURRENT")
        if current is None:
            raise CollectionError(f"no collection {self.name!r}")
        self._manifest = json.loads(self.files.read(f"{self.path}/manifest-{int(current)}.json") or "null")
        self._read_at = time.monotonic()
        return self._manifest

    def version(self) -> int:
        return int(self.manifest()["version"])

    def _publish(self, old: dict[str, Any], **changes: Any) -> dict[str, Any]:
        new = old | changes | {"version": old["version"] + 1}
        if not self.files.write(f"{self.path}/manifest-{new['version']}.json", json.dumps(new), new=True):
            raise CollectionError(f"{self.name!r} was written meanwhile")
        self.files.write(f"{self.path}/CURRENT", str(new["version"]))
        self._manifest, self._read_at, self._written = new, time.monotonic(), new["version"]
        for df in self._loaded.values():
            df.unpersist()
        self._loaded.clear()
        if self.cache is not None:
            self.cache.invalidate(self.name, new["version"])
        return new

    # --- reads

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest()["schema"]))

    @property
    def key(self) -> str:
        return self.manifest()["key"]

    def df(self, partitions: Sequence[str] = (), consistency: str | None = None, with_partition: bool = False) -> DataFrame:
        """The rows; of named partitions only their folders are listed."""
        m = self.manifest(consistency)
        missing = set(partitions) - set(m["partitions"])
        if missing:
            raise PartitionError(f"no partition {sorted(missing)}")
        schema = T.StructType([*T.StructType.fromJson(json.loads(m["schema"])).fields, T.StructField(_PARTITION, T.StringType())])
        loaded = self._loaded.get(tuple(sorted(partitions)))
        if loaded is not None:
            df = loaded
        else:
            paths = [f"{self.path}/{p['path']}" for p in m["parts"] if not partitions or p["partition"] in partitions]
            df = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return df if with_partition else df.drop(_PARTITION)

    @property
    def objects(self) -> Query:
        vectors = tuple(f.name for f in self.schema.fields if str((f.metadata or {}).get("store_type", "")).endswith("_VECTOR"))
        return Query(lambda spec: self.df(spec.partitions, spec.consistency, True), self.key, vectors, _PARTITION, self)

    def query_raw(self, filter_expr: str = "", output_fields: Sequence[str] | None = None, limit: int = 100, offset: int = 0) -> list[dict[str, Any]]:
        """Rows by a filter text, past the cache."""
        q = self.objects.filter(filter_expr) if filter_expr else self.objects
        q = q.only(*output_fields) if output_fields else q.only(*self.schema.names)
        return [r.asDict(recursive=True) for r in q.limit(limit).offset(offset).to_df().collect()]

    def search_raw(self, data: Any, anns_field: str, limit: int = 10, output_fields: Sequence[str] | None = None, search_params: dict[str, Any] | None = None, filter_expr: str = "") -> list[dict[str, Any]]:
        q = self.objects.filter(filter_expr) if filter_expr else self.objects
        return [r.asDict(recursive=True) for r in q.search(data, anns_field, limit, search_params=search_params, output_fields=output_fields).to_df().collect()]

    def stats(self) -> dict[str, int]:
        return {"row_count": self.manifest("Strong")["row_count"]}

    def cached_rows(self, q: Query) -> list[dict[str, Any]]:
        """Rows of a query through the result cache, or past it where settings, model and query do not ask for it."""
        from vecframe.cache.config import options

        produce = q.fetched
        level = q.spec.consistency
        opts = options(self.cache.config, self.model.options.cache if self.model else None, dict(q.spec.cache))
        if opts is None or (level == "Strong" and not self.cache.config["STRONG_CONSISTENCY"]):
            return produce()
        self.cache.versions.observe(self.name, self.version())
        r = q.spec.search
        if r is not None and not isinstance(r.data, dict):
            from dataclasses import replace

            field = q._vector_field(r.anns_field)
            ctx = (replace(q.spec, search=replace(r, data=None), cache=()).fingerprint(),)

            def wider(n: int) -> list[dict[str, Any]]:
                more = replace(q, spec=replace(q.spec, search=replace(r, limit=n, output_fields=tuple(dict.fromkeys((*(r.output_fields or ()), field))))))
                return [row.asDict(recursive=True) for row in more.to_df().collect()]

            return self.cache.search(self.name, r.data, field, r.metric_type or q.default_metric, ctx, r.limit, wider if opts.get("semantic", {}) not in (None, False) else lambda n: produce(), self.key, opts.get("ttl_override"), dict(q.spec.cache).get("semantic"), bool(opts.get("refresh"))).value
        return self.cache.read(self.name, "h" if q.spec.hybrid else "q", (q.spec.fingerprint(),), produce, dict(q.spec.cache).get("ttl"), bool(opts.get("refresh"))).value

    def cached_count(self, q: Query) -> int:
        """The count of a query through the result cache, under the same rules as its rows."""
        from vecframe.cache.config import options

        opts = options(self.cache.config, self.model.options.cache if self.model else None, dict(q.spec.cache))
        if opts is None or (q.spec.consistency == "Strong" and not self.cache.config["STRONG_CONSISTENCY"]):
            return q.counted()
        self.cache.versions.observe(self.name, self.version())
        return int(self.cache.read(self.name, "c", (q.spec.fingerprint(),), q.counted, dict(q.spec.cache).get("ttl"), bool(opts.get("refresh"))).value)

    def cache_stats(self) -> dict[str, Any]:
        return self.cache.report() if self.cache is not None else {}

    def cache_clear(self) -> None:
        if self.cache is not None:
            self.cache.clear(self.name)

    def cache_warm(self, vectors: Iterable[Sequence[float]] = (), queries: Iterable[Query] = (), field: str | None = None, limit: int = 10) -> tuple[int, list[Exception]]:
        """Run queries and searches for their cache entries; how many went well, and what failed."""
        if self.cache is None:
            return 0, []
        jobs = [q.cache().rows for q in queries] + [self.objects.cache().search(list(v), field, limit).rows for v in vectors]
        return self.cache.warm(jobs)

    # --- residency

    def load(self, partitions: Sequence[str] = ()) -> None:
        """Keep the rows in the executors' memory and on their disks."""
        df = self.df(partitions, with_partition=True).persist()
        self._loaded[tuple(sorted(partitions))] = df
        if self.cache is not None:
            self.cache.loads.mark(self.name)

    def release(self) -> None:
        for df in self._loaded.values():
            df.unpersist()
        self._loaded.clear()
        if self.cache is not None:
            self.cache.loads.forget(self.name)

    def load_state(self) -> str:
        return "Loaded" if self._loaded else "NotLoad"

    def flush(self) -> None:
        """Writes are durable when they return; there is nothing to do."""

    # --- writes

    def _prepared(self, df: DataFrame, m: dict[str, Any], partition: str | None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], *([F.col(_PARTITION)] if _PARTITION in df.columns else []))
        if _PARTITION not in df.columns:
            by, n = m["options"].get("partition_key_field"), m["options"].get("num_partitions") or 16
            where = F.lit(partition or DEFAULT_PARTITION) if not by or partition else F.concat(F.lit("_key_"), F.pmod(F.xxhash64(by), F.lit(n)).cast("string"))
            df = df.withColumn(_PARTITION, where)
        return df

    def _write(self, df: DataFrame, m: dict[str, Any]) -> list[dict[str, Any]]:
        """New parts of the rows, one folder per partition."""
        folder = f"data/snap={m['version'] + 1}-{uuid.uuid4().hex[:8]}"
        rows = df.withColumn("_p", F.col(_PARTITION))
        shards = int(m["options"].get("shards_num") or 1)
        if shards > 1:
            rows = rows.repartition(shards, m["key"])
        scalar = [i for i in m["indexes"].values() if i["index_type"] in I.SCALAR]
        if scalar:
            rows = rows.sortWithinPartitions(*[i["field_name"] for i in scalar])
        writer = rows.write.partitionBy("_p").option("compression", "zstd")
        for i in scalar:
            if i["index_type"] == "INVERTED":
                writer = writer.option(f"parquet.bloom.filter.enabled#{i['field_name']}", "true")
        writer.parquet(f"{self.path}/{folder}")
        from urllib.parse import unquote

        found = [p for p in self.files.list(f"{self.path}/{folder}") if p.startswith("_p=")]
        counts = {r[_PARTITION]: int(r["count"]) for r in self.spark.read.schema(f"{_PARTITION} string").parquet(*[f"{self.path}/{folder}/{p}" for p in found]).groupBy(_PARTITION).count().collect()} if found else {}
        return [{"path": f"{folder}/{p}", "partition": unquote(p[3:]), "rows": counts.get(unquote(p[3:]), 0)} for p in found]

    def insert(self, rows: DataFrame | Iterable[dict[str, Any] | Model], partition: str | None = None) -> dict[str, Any]:
        """Append rows; automatic keys are dense and start where the last write ended."""
        m = self.manifest("Strong")
        if partition and partition not in m["partitions"]:
            raise PartitionError(f"no partition {partition!r}")
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        next_id, ids = m["next_id"], []
        auto = bool((schema[m["key"]].metadata or {}).get("auto_id")) and isinstance(schema[m["key"]].dataType, T.LongType)
        if isinstance(rows, DataFrame):
            df = rows
            if auto and m["key"] not in df.columns:
                df, next_id = self._numbered(df, m["key"], next_id)
        else:
            rows = list(rows)
            if not rows:
                raise ValidationError("nothing to insert")
            if self.model is not None:
                data = [list(t) for t in encode_rows(self.model, rows)]
            else:
                data = [[(r if isinstance(r, dict) else r.to_dict()).get(n) for n in schema.names] for r in rows]
            at = schema.names.index(m["key"])
            for d in data:
                if d[at] is None:
                    if not auto:
                        raise ValidationError(f"{m['key']} is missing")
                    d[at], next_id = next_id, next_id + 1
                elif auto:
                    next_id = max(next_id, d[at] + 1)
                ids.append(d[at])
            df = self.spark.createDataFrame([tuple(d) for d in data], schema)
            for r, i in zip(rows, ids, strict=True):
                if isinstance(r, Model):
                    r.data[m["key"]] = i
                    object.__setattr__(r, "is_new", False)
        parts = self._write(self._prepared(df, m, partition), m)
        added = sum(p["rows"] for p in parts)
        new = self._publish(m, parts=m["parts"] + parts, partitions=sorted({*m["partitions"], *(p["partition"] for p in parts)}), row_count=m["row_count"] + added, next_id=next_id)
        return {"insert_count": added, "ids": ids, "version": new["version"]}

    def _numbered(self, df: DataFrame, key: str, start: int) -> tuple[DataFrame, int]:
        """Dense keys: rows are written once, numbered within their tasks, and shifted by the counts of the tasks before."""
        tmp = f"{self.path}/tmp/{uuid.uuid4().hex}"
        df.write.parquet(tmp)
        rows = self.spark.read.schema(df.schema).parquet(tmp).withColumn("_m", F.monotonically_increasing_id())
        counts = {r["t"]: int(r["n"]) for r in rows.groupBy(F.shiftright("_m", 33).alias("t")).agg(F.count("*").alias("n")).collect()}
        shifts, at = {}, start
        for t in sorted(counts):
            shifts[t] = at
            at += counts[t]
        table = F.create_map(*[F.lit(v) for kv in shifts.items() for v in kv]) if shifts else F.create_map(F.lit(0), F.lit(start))
        out = rows.withColumn(key, (table[F.shiftright("_m", 33)] + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_m")
        return out, at

    def bulk_create(self, rows: DataFrame | Iterable[dict[str, Any] | Model], partition: str | None = None, batch_size: int | None = None) -> dict[str, Any] | list[dict[str, Any]]:
        """Append rows; with a ``batch_size`` rows given one by one go in as many writes, and each one's result is returned."""
        if batch_size is None or isinstance(rows, DataFrame):
            return self.insert(rows, partition)
        if batch_size < 1:
            raise ValidationError("a batch holds a row at least")
        rows = list(rows)
        return [self.insert(rows[i : i + batch_size], partition) for i in range(0, len(rows), batch_size)]

    def upsert(self, rows: DataFrame | Iterable[dict[str, Any] | Model], order: Sequence[Column | str] | None = None, partition: str | None = None) -> dict[str, Any]:
        """Insert or replace by key. Of rows of one key the last one given counts (for a DataFrame, the first by
        ``order``). Only partitions that hold a replaced key are written anew."""
        m = self.manifest("Strong")
        key, next_id = m["key"], m["next_id"]
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        if isinstance(rows, DataFrame):
            # Written once: it is read several times below, and must be the same every time.
            staged = f"{self.path}/tmp/{uuid.uuid4().hex}"
            (mutate.last_of(rows, key, order) if order else rows).write.parquet(staged)
            delta = self.spark.read.schema(rows.schema).parquet(staged)
            if not order and not delta.groupBy(key).count().where("count > 1").isEmpty():
                self.files.delete(staged)
                raise ValidationError(f"the rows repeat a {key}: name the order that decides")
        else:
            rows = list(rows)
            data = encode_rows(self.model, rows) if self.model is not None else [tuple((r if isinstance(r, dict) else r.to_dict()).get(n) for n in schema.names) for r in rows]
            last = {d[schema.names.index(key)]: d for d in data}
            if None in last:
                raise ValidationError(f"{key} is missing")
            if isinstance(schema[key].dataType, T.LongType) and last:
                next_id = max(next_id, max(last) + 1)
            delta = self.spark.createDataFrame(list(last.values()), schema)
        delta = self._prepared(delta, m, partition)
        base = self.df(consistency="Strong", with_partition=True)
        # A few names: which partitions hold keys of the delta.
        touched = {r[0] for r in base.join(delta.select(key), key, "left_semi").select(_PARTITION).distinct().collect()}
        keep = [p for p in m["parts"] if p["partition"] not in touched]
        old = base.where(F.col(_PARTITION).isin(*touched)) if touched else base.limit(0)
        parts = self._write(mutate.upsert(old, delta, key), m)
        if isinstance(rows, DataFrame):
            self.files.delete(staged)
        rows_now = sum(p["rows"] for p in keep + parts)
        new = self._publish(m, parts=keep + parts, partitions=sorted({*m["partitions"], *(p["partition"] for p in parts)}), row_count=rows_now, next_id=next_id)
        return {"row_count": rows_now, "version": new["version"]}

    def _rewrite(self, kept: DataFrame, m: dict[str, Any], parts: Sequence[dict[str, Any]]) -> int:
        """Publish ``kept`` in place of ``parts``; returns how many rows went."""
        rest = [p for p in m["parts"] if p not in parts]
        new = self._write(kept, m)
        count = sum(p["rows"] for p in rest + new)
        self._publish(m, parts=rest + new, row_count=count)
        return m["row_count"] - count

    def delete_where(self, spec: Spec) -> int:
        """Delete the rows a filter leaves, in the named partitions (all of them if none is named)."""
        m = self.manifest("Strong")
        parts = [p for p in m["parts"] if not spec.partitions or p["partition"] in spec.partitions]
        base = self.df(spec.partitions, "Strong", True)
        condition = P.to_column(spec.condition(), base.schema)
        # Parts without a row to delete stay as they are.
        touched = {r[0] for r in base.where(F.coalesce(condition, F.lit(False))).select(_PARTITION).distinct().collect()}
        if not touched:
            return 0
        parts = [p for p in parts if p["partition"] in touched]
        return self._rewrite(mutate.delete_where(base.where(F.col(_PARTITION).isin(*touched)), condition), m, parts)

    def delete_by_ids(self, ids: Iterable[Any]) -> int:
        m = self.manifest("Strong")
        keys_given = list(ids)
        keys = self.spark.createDataFrame([(i,) for i in keys_given], T.StructType([T.StructField(m["key"], self.schema[m["key"]].dataType)]))
        base = self.df(consistency="Strong", with_partition=True)
        # A few names: only partitions that hold one of the keys are written anew.
        touched = {r[0] for r in base.join(F.broadcast(keys) if len(keys_given) <= 100_000 else keys, m["key"], "left_semi").select(_PARTITION).distinct().collect()}
        if not touched:
            return 0
        parts = [p for p in m["parts"] if p["partition"] in touched]
        return self._rewrite(mutate.delete_keys(base.where(F.col(_PARTITION).isin(*touched)), keys, m["key"]), m, parts)

    # --- single instances

    def save(self, instance: Model) -> Model:
        if instance.is_new:
            self.insert([instance])
        else:
            self.upsert([instance])
        return instance

    def create(self, **values: Any) -> Model:
        if self.model is None:
            raise CollectionError("this collection has no model")
        return self.save(self.model(**values))

    def delete(self, instance: Model) -> int:
        if instance.pk is None:
            raise ValidationError("an instance without a key cannot be deleted")
        n = self.delete_by_ids([instance.pk])
        object.__setattr__(instance, "is_new", True)
        return n

    def refresh(self, instance: Model) -> Model:
        rows = self.df(consistency="Strong").where(F.col(self.key) == F.lit(instance.pk)).limit(1).collect()
        if not rows:
            raise ObjectDoesNotExist(str(instance.pk))
        fresh = type(instance).from_dict(rows[0].asDict(recursive=True))
        instance.data.update(fresh.data)
        return instance

    # --- partitions

    def create_partition(self, name: str) -> None:
        m = self.manifest("Strong")
        if name in m["partitions"]:
            raise PartitionError(f"{name!r} exists")
        self._publish(m, partitions=sorted({*m["partitions"], name}))

    def drop_partition(self, name: str) -> None:
        m = self.manifest("Strong")
        if name not in m["partitions"] or name == DEFAULT_PARTITION:
            raise PartitionError(f"cannot drop {name!r}")
        keep = [p for p in m["parts"] if p["partition"] != name]
        self._publish(m, partitions=[p for p in m["partitions"] if p != name], parts=keep, row_count=sum(p["rows"] for p in keep))

    def has_partition(self, name: str) -> bool:
        return name in self.manifest("Strong")["partitions"]

    def partitions(self) -> list[str]:
        return list(self.manifest("Strong")["partitions"])

    def partition_stats(self, name: str) -> dict[str, int]:
        return {"row_count": sum(p["rows"] for p in self.manifest("Strong")["parts"] if p["partition"] == name)}

    # --- indexes

    def create_index(self, spec: I.IndexSpec, build: bool = False) -> None:
        """Record an index; it is built by the first search that uses it, or at once."""
        if spec.field_name not in self.schema.names:
            raise IndexError_(f"no field {spec.field_name!r}")
        m = self.manifest("Strong")
        self._publish(m, indexes=m["indexes"] | {spec.field_name: spec.to_dict()})
        if build:
            self.build_index(spec.field_name)

    def list_indexes(self) -> list[str]:
        return sorted(self.manifest("Strong")["indexes"])

    def describe_index(self, field: str) -> dict[str, Any]:
        try:
            return self.manifest("Strong")["indexes"][field]
        except KeyError:
            raise IndexError_(f"no index on {field!r}") from None

    def drop_index(self, field: str) -> None:
        m = self.manifest("Strong")
        if field not in m["indexes"]:
            raise IndexError_(f"no index on {field!r}")
        self._publish(m, indexes={k: v for k, v in m["indexes"].items() if k != field})

    def build_index(self, field: str) -> _StoredIndex | None:
        """Write the inverted file of a vector field for the version in force, partitioned by cluster."""
        m = self.manifest("Strong")
        d = m["indexes"].get(field)
        if d is None:
            raise IndexError_(f"no index on {field!r}")
        kind, params = d["index_type"], dict(d["params"])
        if kind == "AUTOINDEX":
            kind, auto = I.auto_type(m["row_count"])
            params |= auto
        if kind == "FLAT" or kind in I.SCALAR or kind.startswith(("BIN_", "SPARSE_")):
            return None
        # A graph's contract is met by an inverted file, whose probes stand for the search width.
        nlist = int(params.get("nlist") or max(1, int(4 * m["row_count"] ** 0.5)))
        code = {"IVF_SQ8": "SQ8", "IVF_PQ": "PQ", "SCANN": "PQ"}.get(kind, "FLAT")
        ivf = I.InvertedFile.build(self.df(consistency="Strong").select(m["key"], field), m["key"], field, nlist, code, int(params.get("m", 8)), int(params.get("nbits", 8)))
        at = f"{self.path}/index/{field}-{m['version']}"
        # One file a cluster; AQE would merge the small ones into shared tasks, which is as good.
        ivf.rows.repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{at}/rows")
        arrays = {k: np.asarray(v).tolist() for k, v in (("centres", ivf.centres), ("low", ivf.low), ("step", ivf.step), ("books", ivf.books)) if v is not None}
        self.files.write(f"{at}/meta.json", json.dumps(arrays))
        return self._stored_index(field, m)

    def _stored_index(self, field: str, m: dict[str, Any]) -> _StoredIndex | None:
        at = f"{self.path}/index/{field}-{m['version']}"
        meta = self.files.read(f"{at}/meta.json")
        if meta is None:
            return None
        a = {k: np.array(v) for k, v in json.loads(meta).items()}
        rows = self.spark.read.parquet(f"{at}/rows") if len(a["centres"]) else self.df().select(m["key"], field).limit(0).withColumn("cluster", F.lit(0))
        return _StoredIndex(I.InvertedFile(m["key"], field, a["centres"], rows, a.get("low"), a.get("step"), a.get("books")), m["indexes"][field])

    def usable_index(self, field: str, metric_name: str, params: dict[str, Any]) -> _StoredIndex | None:
        """The index a search of this field may use; built on first use. None: scan exactly."""
        m = self.manifest()
        d = m["indexes"].get(field)
        if d is None or d["metric_type"] != metric_name.upper() or params.get("exact"):
            return None
        return self._stored_index(field, m) or self.build_index(field)


class _StoredIndex:
    def __init__(self, ivf: I.InvertedFile, described: dict[str, Any]) -> None:
        self.ivf, self.described = ivf, described

    def search(self, base: DataFrame | None, key: str, vector: str, query: Sequence[float], k: int, metric_name: str, params: dict[str, Any]) -> DataFrame:
        """Best rows of the probed clusters; ``base`` holds the rows a filter leaves (None: all), and only then is read."""
        nlist = len(self.ivf.centres)
        nprobe = int(params.get("nprobe") or max(int(params.get("ef", 64)) // 8, math.ceil(I.PROBE_SHARE * nlist)))
        shortlist = None if self.described["index_type"] == "IVF_SQ8" and not params.get("rerank") else max(10 * k, 100)
        ivf = I.InvertedFile(key, vector, self.ivf.centres, self.ivf.rows if base is None else self.ivf.rows.join(base.select(key), key, "left_semi"), self.ivf.low, self.ivf.step, self.ivf.books)
        return ivf.search(query, k, nprobe, metric_name, shortlist)


def connect(spark: SparkSession, root: str | None = None, database: str = "default", cache: ResultCache | None = None) -> Catalog:
    """The catalog at a root folder (default: ``VECFRAME_ROOT`` or the session's warehouse)."""
    return Catalog(spark, root or os.environ.get("VECFRAME_ROOT") or spark.conf.get("spark.sql.warehouse.dir"), database, cache)


