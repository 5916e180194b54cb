"""Exceptions of the engine: bad input raises IndexInputError, a bad search SearchError."""

from __future__ import annotations


class LodestoneError(Exception):
    """Base of all."""


class IndexInputError(LodestoneError, ValueError):
    """The indexed rows cannot be used."""


class SearchError(LodestoneError, RuntimeError):
    """A search cannot be run."""


class ShapeMismatch(IndexInputError):
    def __init__(self, rows: int, dims: int, length: int | None = None):
        super().__init__(f"rows={rows}, dims={dims}" + (f", but {length} values" if length is not None else ""))
        self.rows, self.dims, self.length = rows, dims, length


class InconsistentDims(IndexInputError):
    def __init__(self, smallest: int, largest: int):
        super().__init__(f"rows have between {smallest} and {largest} dimensions")


class NullValues(IndexInputError):
    pass


class NonFiniteInput(IndexInputError):
    pass


class ZeroNorm(IndexInputError):
    pass


class InvalidQueryIds(SearchError, ValueError):
    """Null or repeated ids of queries."""


class InvalidTopK(SearchError):
    def __init__(self, k: int):
        super().__init__(f"k must be at least 1, not {k}")


class QueryDimensionMismatch(SearchError, ValueError):
    def __init__(self, expected: int, found: int):
        super().__init__(f"the index has {expected} dimensions, a query {found}")
        self.expected, self.found = expected, found


class BackendUnavailable(IndexInputError):
    pass


class PayloadMismatch(IndexInputError):
    pass


class LoadError(IndexInputError):
    pass


class UnsupportedExtension(LoadError):
    pass


class MissingKey(LoadError):
    pass


class KeyNotFound(LoadError):
    pass


class UnsupportedColumnType(LoadError):
    pass


class NoProvider(LodestoneError, RuntimeError):
    """No provider of a chain can be used."""


class ModelMismatch(LoadError):
    """An index of one model asked with vectors of another."""
