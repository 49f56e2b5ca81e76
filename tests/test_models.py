"""Fields, validation, row codec."""

from __future__ import annotations

import pytest

from vecframe.errors import FieldError, SchemaError, ValidationError
from vecframe.plans import model as M


class Doc(M.Model):
    id = M.Int64PrimaryKey()
    title = M.VarCharField(5)
    score = M.FloatField(default=0.5)
    tags = M.JSONField(default=dict, nullable=True)
    embedding = M.FloatVectorField(3)

    class Meta:
        enable_dynamic_field = True


class Child(Doc):
    extra = M.Int8Field(nullable=True)


def test_fields_keep_order_and_inherit():
    assert list(Doc.fields) == ["id", "title", "score", "tags", "embedding"]
    assert list(Child.fields)[-1] == "extra"
    assert Child.options.collection_name == "child" and not Child.options.enable_dynamic_field
    assert Doc.vector_fields() == ["embedding"]
    assert Doc.field_names(include_key=False, include_vectors=False) == ["title", "score", "tags"]


def test_defaults_and_dynamic():
    d = Doc(title="a", embedding=[1, 2, 3], colour="red")
    assert d.score == 0.5 and d.tags == {} and d.colour == "red" and d.pk is None
    assert d.to_dict() == {"title": "a", "score": 0.5, "tags": "{}", "embedding": [1.0, 2.0, 3.0], "colour": "red"}
    with pytest.raises(ValidationError):
        Child(title="a", embedding=[1, 2, 3], colour="red")


@pytest.mark.parametrize(("field", "bad"), [("title", "toolong"), ("embedding", [1, 2]), ("embedding", "abc"), ("id", "x")])
def test_validation(field, bad):
    with pytest.raises(ValidationError):
        Doc(**{"title": "a", "embedding": [1, 2, 3], field: bad})
    d = Doc(title="a", embedding=[1, 2, 3])
    with pytest.raises(ValidationError):
        setattr(d, field, bad)


def test_ranges():
    M.Int8Field().validate(-128)
    with pytest.raises(ValidationError):
        M.Int8Field().validate(128)
    with pytest.raises(ValidationError):
        M.Int64Field().validate(1 << 63)
    with pytest.raises(FieldError):
        M.BinaryVectorField(12)
    M.BinaryVectorField(16).validate(b"ab")
    with pytest.raises(ValidationError):
        M.BinaryVectorField(16).validate(b"a")


def test_rounding_of_half_vectors():
    assert M.BFloat16VectorField(1)._encode([1.00390625 + 0.001]) == [1.0]
    assert M.Float16VectorField(1)._encode([0.1])[0] == pytest.approx(0.0999755859375)


def test_identity_and_codec():
    a, b = Doc.from_dict({"id": 1, "title": "x", "tags": '{"a": 1}'}), Doc.from_dict({"id": 1, "z": 2})
    assert a == b and hash(a) == hash(b) and a.tags == {"a": 1} and b.title is None and b.z == 2
    assert Doc(title="a", embedding=[1, 2, 3]) != Doc(title="a", embedding=[1, 2, 3])


def test_schema_needs_a_key():
    class NoKey(M.Model):
        x = M.BoolField()

    with pytest.raises(SchemaError):
        NoKey.schema()
    s = Doc.schema()
    assert s["embedding"].metadata["dim"] == 3 and s.names[-1] == "_dynamic"


def test_store_types():
    assert [M.store_type_of(v) for v in (True, 1, 1.0, "a", b"a", [1.0], {})] == ["BOOL", "INT64", "DOUBLE", "VARCHAR", "BINARY_VECTOR", "FLOAT_VECTOR", "JSON"]
