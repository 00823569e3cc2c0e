"""Array and code-vector helpers (X1-X3, R1-R7). All return Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the accepted layout of a code vector: a bracket, digits and spaces, a bracket.
CODE_VECTOR_PATTERN = r"^\[[0-9 ]*\]$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it. Inside the function of an array
    Spark computes an expression anew wherever it stands; here it is the one element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def codes_to_array(s) -> Column:
    """``"[11 2 3]"`` → ``[11, 2, 3]`` (digit runs, as BIGINT)."""
    return F.transform(F.regexp_extract_all(_c(s), F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))


def is_code_vector(s) -> Column:
    """X1 strict form check; rows failing it are reported, not silently parsed."""
    return _c(s).rlike(CODE_VECTOR_PATTERN)


def codes_text(s) -> Column:
    """Every digit run, joined by single spaces (signs are dropped)."""
    return F.array_join(F.regexp_extract_all(_c(s), F.lit(r"(\d+)"), 1), " ")


def last_n(a, n: int) -> Column:
    """The last ``n`` elements; the whole array when it is shorter."""
    arr = _c(a)
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), F.lit(n))


def position_of(a, v) -> Column:
    """1-based position of ``v`` in ``a``; 0 when absent."""
    return F.array_position(_c(a), _c(v))
