"""Exceptions of the engine; all derive from :class:`VecframeError`."""

from __future__ import annotations


class VecframeError(Exception):
    """Root of the taxonomy."""


class ConnectionFailed(VecframeError):
    """No usable session or storage root."""


class CollectionError(VecframeError):
    """A collection is missing, exists already, or cannot be written."""


class SchemaError(VecframeError):
    """A model cannot be turned into a schema."""


class FieldError(VecframeError):
    """A field is declared with invalid options."""


class ValidationError(VecframeError):
    """A value does not fit its field, or an operation lacks what it needs."""


class IndexError_(VecframeError):
    """An index is unknown or cannot be built."""


class PartitionError(VecframeError):
    """A partition is missing or exists already."""


class SearchError(VecframeError):
    """A search lacks a vector field, a vector or a metric."""


class ExpressionError(VecframeError):
    """A filter text does not follow the grammar."""


class ObjectDoesNotExist(VecframeError):
    """``get`` found nothing."""


class MultipleObjectsReturned(VecframeError):
    """``get`` found more than one row."""


class CacheError(VecframeError):
    """Something in the result cache failed."""


class CacheConfigurationError(CacheError):
    """The cache settings contradict themselves."""


class CacheBackendError(CacheError):
    """A storage tier of the cache failed."""
