"""Declared models: field descriptors, validation, defaults, and the Spark schema they stand for."""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import types as T

from vecframe.errors import FieldError, SchemaError, ValidationError

_order = itertools.count()
_MISSING = object()


class Field:
    """A typed column. ``default`` may be a value or a callable; a callable never enters the schema."""

    spark_type: T.DataType = T.StringType()
    store_type = "VARCHAR"
    is_vector = False

    def __init__(self, *, primary_key: bool = False, auto_id: bool = False, nullable: bool = False, default: Any = None, description: str = "") -> None:
        self.primary_key, self.auto_id, self.nullable, self.default, self.description = primary_key, auto_id, nullable, default, description
        self.order = next(_order)
        self.name = ""

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def validate(self, value: Any) -> None:
        """Raise :class:`ValidationError` if the value does not fit."""

    def encode(self, value: Any) -> Any:
        """Value as written: the default stands for a missing value."""
        if value is None:
            value = self.default() if callable(self.default) else self.default
        return value if value is None else self._encode(value)

    def decode(self, value: Any) -> Any:
        return value if value is None else self._decode(value)

    def _encode(self, value: Any) -> Any:
        return value

    def _decode(self, value: Any) -> Any:
        return value

    def initial(self) -> Any:
        return self.default() if callable(self.default) else self.default

    def metadata(self) -> dict[str, Any]:
        meta: dict[str, Any] = {"store_type": self.store_type}
        if self.primary_key:
            meta |= {"pk": True, "auto_id": self.auto_id}
        if self.default is not None and not callable(self.default):
            meta["default"] = json.dumps(self.default)
        if self.description:
            meta["description"] = self.description
        return meta

    def struct_field(self) -> T.StructField:
        return T.StructField(self.name, self.spark_type, True, self.metadata())

    def _fail(self, why: str) -> None:
        raise ValidationError(f"{self.name or type(self).__name__}: {why}")


class BoolField(Field):
    spark_type, store_type = T.BooleanType(), "BOOL"

    def _encode(self, value: Any) -> bool:
        return bool(value)

    _decode = _encode


class _IntField(Field):
    bits = 64

    def validate(self, value: Any) -> None:
        if value is None:
            return
        if isinstance(value, bool) or not isinstance(value, int | np.integer):
            self._fail(f"{value!r} is no integer")
        top = 1 << (self.bits - 1)
        if not -top <= value < top:
            self._fail(f"{value} is out of range")


class Int8Field(_IntField):
    spark_type, store_type, bits = T.ByteType(), "INT8", 8


class Int16Field(_IntField):
    spark_type, store_type, bits = T.ShortType(), "INT16", 16


class Int32Field(_IntField):
    spark_type, store_type, bits = T.IntegerType(), "INT32", 32


class Int64Field(_IntField):
    spark_type, store_type = T.LongType(), "INT64"


class FloatField(Field):
    spark_type, store_type = T.FloatType(), "FLOAT"

    def _decode(self, value: Any) -> float:
        return float(value)

    _encode = _decode


class DoubleField(FloatField):
    spark_type, store_type = T.DoubleType(), "DOUBLE"


class VarCharField(Field):
    def __init__(self, max_length: int = 256, **options: Any) -> None:
        super().__init__(**options)
        self.max_length = max_length

    def validate(self, value: Any) -> None:
        if value is not None and len(str(value)) > self.max_length:
            self._fail(f"longer than {self.max_length} characters")

    def _encode(self, value: Any) -> str:
        return str(value)

    def metadata(self) -> dict[str, Any]:
        return super().metadata() | {"max_length": self.max_length}


class JSONField(Field):
    """Kept as JSON text; dicts and lists are written as such and read back parsed."""

    store_type = "JSON"

    def _encode(self, value: Any) -> str:
        return value if isinstance(value, str) else json.dumps(value)

    def _decode(self, value: Any) -> Any:
        if not isinstance(value, str):
            return value
        try:
            return json.loads(value)
        except ValueError:
            return value


_ELEMENTS: dict[str, T.DataType] = {
    "BOOL": T.BooleanType(), "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT64": T.LongType(),
    "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(),
}


class ArrayField(Field):
    store_type = "ARRAY"

    def __init__(self, element_type: str = "INT64", max_capacity: int = 4096, max_length: int = 256, **options: Any) -> None:
        super().__init__(**options)
        if element_type not in _ELEMENTS:
            raise FieldError(f"no element type {element_type!r}")
        self.element_type, self.max_capacity, self.max_length = element_type, max_capacity, max_length
        self.spark_type = T.ArrayType(_ELEMENTS[element_type])

    def validate(self, value: Any) -> None:
        if value is not None and len(value) > self.max_capacity:
            self._fail(f"more than {self.max_capacity} elements")

    def metadata(self) -> dict[str, Any]:
        return super().metadata() | {"element_type": self.element_type, "max_capacity": self.max_capacity}


class FloatVectorField(Field):
    store_type, is_vector = "FLOAT_VECTOR", True
    spark_type = T.ArrayType(T.FloatType())

    def __init__(self, dim: int, **options: Any) -> None:
        super().__init__(**options)
        if dim < 1:
            raise FieldError("a vector needs a dimension")
        self.dim = dim

    def validate(self, value: Any) -> None:
        if value is None:
            return
        if not isinstance(value, list | tuple | np.ndarray):
            self._fail("a vector is a list of numbers")
        if len(value) != self.dim:
            self._fail(f"{len(value)} components instead of {self.dim}")

    def _encode(self, value: Any) -> list[float]:
        return [float(v) for v in value]

    def metadata(self) -> dict[str, Any]:
        return super().metadata() | {"dim": self.dim}


class Float16VectorField(FloatVectorField):
    """Stored as floats rounded to half precision."""

    store_type = "FLOAT16_VECTOR"

    def _encode(self, value: Any) -> list[float]:
        return np.asarray(value, dtype=np.float16).astype(np.float32).tolist()


class BFloat16VectorField(FloatVectorField):
    """Stored as floats whose mantissa is cut to seven bits."""

    store_type = "BFLOAT16_VECTOR"

    def _encode(self, value: Any) -> list[float]:
        x = np.asarray(value, dtype=np.float32).copy()
        return (x.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32).tolist()


class BinaryVectorField(Field):
    store_type, is_vector = "BINARY_VECTOR", True
    spark_type = T.BinaryType()

    def __init__(self, dim: int, **options: Any) -> None:
        super().__init__(**options)
        if dim < 1 or dim % 8:
            raise FieldError("a binary vector's dimension is a multiple of eight")
        self.dim = dim

    def validate(self, value: Any) -> None:
        if value is not None and len(value) * 8 != self.dim:
            self._fail(f"{len(value)} bytes instead of {self.dim // 8}")

    def _encode(self, value: Any) -> bytes:
        return bytes(value)

    def metadata(self) -> dict[str, Any]:
        return super().metadata() | {"dim": self.dim}


class SparseFloatVectorField(Field):
    store_type, is_vector = "SPARSE_FLOAT_VECTOR", True
    spark_type = T.MapType(T.IntegerType(), T.FloatType())

    def validate(self, value: Any) -> None:
        if value is not None and not isinstance(value, dict):
            self._fail("a sparse vector maps indices to weights")

    def _encode(self, value: Any) -> dict[int, float]:
        return {int(k): float(v) for k, v in value.items()}


class PrimaryKeyField(Field):
    def __init__(self, field_type: str = "int64", auto_id: bool = True, max_length: int = 128, **options: Any) -> None:
        super().__init__(primary_key=True, auto_id=auto_id, **options)
        if field_type not in ("int64", "varchar"):
            raise FieldError(f"no key type {field_type!r}")
        self.max_length = max_length
        self.spark_type = T.LongType() if field_type == "int64" else T.StringType()
        self.store_type = "INT64" if field_type == "int64" else "VARCHAR"

    def validate(self, value: Any) -> None:
        if value is None:
            return
        if self.store_type == "INT64" and (isinstance(value, bool) or not isinstance(value, int | np.integer)):
            self._fail(f"{value!r} is no integer")
        if self.store_type == "VARCHAR" and len(str(value)) > self.max_length:
            self._fail(f"longer than {self.max_length} characters")


class Int64PrimaryKey(PrimaryKeyField):
    def __init__(self, **options: Any) -> None:
        super().__init__("int64", **options)


class VarCharPrimaryKey(PrimaryKeyField):
    def __init__(self, max_length: int = 128, **options: Any) -> None:
        super().__init__("varchar", **{"auto_id": False, "max_length": max_length} | options)


VectorField, CharField, TextField = FloatVectorField, VarCharField, VarCharField
IntegerField, BigIntegerField, SmallIntegerField = Int32Field, Int64Field, Int16Field


@dataclass
class Options:
    """What a model says about its collection."""

    collection_name: str = ""
    database: str = "default"
    description: str = ""
    shards_num: int = 1
    consistency_level: str = "Bounded"
    partition_key_field: str | None = None
    num_partitions: int | None = None
    enable_dynamic_field: bool = False
    auto_load: bool = True
    indexes: list[Any] = field(default_factory=list)
    cache: Any = None


class ModelMeta(type):
    """Gathers declared fields in the order of declaration, those of the bases first."""

    def __new__(mcs, name: str, bases: tuple[type, ...], space: dict[str, Any]) -> type:
        meta = space.pop("Meta", None)
        cls = super().__new__(mcs, name, bases, space)
        fields: dict[str, Field] = {}
        for base in reversed(cls.__mro__[1:]):
            fields |= getattr(base, "_own_fields", {})
        cls._own_fields = dict(sorted(((k, v) for k, v in space.items() if isinstance(v, Field)), key=lambda kv: kv[1].order))
        cls.fields = fields | cls._own_fields
        given = {k: v for k, v in vars(meta).items() if not k.startswith("_")} if meta else {}
        unknown = set(given) - set(Options.__dataclass_fields__)
        if unknown:
            raise SchemaError(f"{name}: no option {sorted(unknown)}")
        cls.options = Options(**given)
        cls.options.collection_name = cls.options.collection_name or name.lower()
        return cls


class Model(metaclass=ModelMeta):
    """A row. Undeclared keywords are kept if the model allows dynamic fields."""

    fields: dict[str, Field]
    options: Options

    def __init__(self, **values: Any) -> None:
        self.data: dict[str, Any] = {}
        self.dynamic: dict[str, Any] = {}
        self.is_new = True
        for k, f in self.fields.items():
            v = values.pop(k, _MISSING)
            v = f.initial() if v is _MISSING else v
            f.validate(v)
            self.data[k] = v
        if values and not self.options.enable_dynamic_field:
            raise ValidationError(f"{type(self).__name__} has no field {sorted(values)}")
        self.dynamic = values

    def __getattribute__(self, name: str) -> Any:
        cls = type(self)
        if name in cls.fields:
            return object.__getattribute__(self, "data").get(name)
        return object.__getattribute__(self, name)

    def __getattr__(self, name: str) -> Any:
        dynamic = self.__dict__.get("dynamic", {})
        if name in dynamic:
            return dynamic[name]
        raise AttributeError(name)

    def __setattr__(self, name: str, value: Any) -> None:
        if name in type(self).fields:
            type(self).fields[name].validate(value)
            self.data[name] = value
        else:
            object.__setattr__(self, name, value)

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.pk is not None and self.pk == other.pk

    def __hash__(self) -> int:
        return hash((type(self), self.pk))

    def __repr__(self) -> str:
        return f"<{type(self).__name__} {self.pk}>"

    @classmethod
    def key_name(cls) -> str:
        for k, f in cls.fields.items():
            if f.primary_key:
                return k
        raise SchemaError(f"{cls.__name__} has no primary key")

    @property
    def pk(self) -> Any:
        return self.data.get(self.key_name())

    def to_dict(self) -> dict[str, Any]:
        """Row as written: without an automatic key that is not known yet, and without missing non-nullable values."""
        out: dict[str, Any] = {}
        for k, f in self.fields.items():
            v = f.encode(self.data.get(k))
            if v is None and ((f.primary_key and f.auto_id) or not f.nullable):
                continue
            out[k] = v
        return out | self.dynamic

    @classmethod
    def from_dict(cls, row: dict[str, Any]) -> Model:
        """Row as read: absent fields are None, undeclared ones dynamic."""
        self = cls.__new__(cls)
        object.__setattr__(self, "data", {k: f.decode(row.get(k)) for k, f in cls.fields.items()})
        object.__setattr__(self, "dynamic", {k: v for k, v in row.items() if k not in cls.fields} if cls.options.enable_dynamic_field else {})
        object.__setattr__(self, "is_new", False)
        return self

    @classmethod
    def schema(cls) -> T.StructType:
        """Spark schema; a dynamic model has a JSON column ``_dynamic`` besides."""
        cls.key_name()
        columns = [f.struct_field() for f in cls.fields.values()]
        if cls.options.enable_dynamic_field:
            columns.append(T.StructField("_dynamic", T.StringType(), True))
        return T.StructType(columns)

    @classmethod
    def field_names(cls, include_key: bool = True, include_vectors: bool = True) -> list[str]:
        return [k for k, f in cls.fields.items() if (include_key or not f.primary_key) and (include_vectors or not f.is_vector)]

    @classmethod
    def vector_fields(cls) -> list[str]:
        return [k for k, f in cls.fields.items() if f.is_vector]


def encode_rows(model: type[Model], rows: Iterable[dict[str, Any] | Model]) -> list[tuple]:
    """Rows in the order of the model's schema, validated; undeclared keys go to ``_dynamic`` or are refused."""
    out = []
    for row in rows:
        given = row.data | row.dynamic if isinstance(row, Model) else dict(row)
        extra = {k: v for k, v in given.items() if k not in model.fields}
        if extra and not model.options.enable_dynamic_field:
            raise ValidationError(f"{model.__name__} has no field {sorted(extra)}")
        values = []
        for k, f in model.fields.items():
            f.validate(given.get(k))
            v = f.encode(given.get(k))
            if v is None and not f.nullable and not (f.primary_key and f.auto_id):
                raise ValidationError(f"{k} is missing")
            values.append(v)
        if model.options.enable_dynamic_field:
            values.append(json.dumps(extra) if extra else None)
        out.append(tuple(values))
    return out


def store_type_of(value: Any) -> str:
    """Store type that a Python value suggests."""
    guesses: tuple[tuple[type, str], ...] = ((bool, "BOOL"), (int, "INT64"), (float, "DOUBLE"), (str, "VARCHAR"), (bytes, "BINARY_VECTOR"), (list, "FLOAT_VECTOR"), (dict, "JSON"))
    for kind, name in guesses:
        if isinstance(value, kind):
            return name
    raise FieldError(f"no store type for {type(value).__name__}")


def pack_floats(vector: Iterable[float]) -> bytes:
    """Little-endian float32 bytes."""
    v = list(vector)
    return struct.pack(f"<{len(v)}f", *v)


