"""A fluent predicate builder that compiles to one Catalyst expression.

Terms are joined left to right, without precedence; `and_`/`or_` work between two terms or after them, `not_`
negates all that was built so far. Columns are names or ordinals. Comparisons follow SQL: exact in the column's type,
null-aware, three-valued.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}
Ref = str | int


@dataclass(frozen=True)
class Term:
    """A leaf: kind is a comparison, is_null, is_not_null, in or not_in."""

    kind: str
    column: Ref
    value: Any = None


@dataclass(frozen=True)
class Node:
    """and, or (two parts) or not (one part)."""

    kind: str
    parts: tuple[Any, ...]


def _column(ref: Ref, df: DataFrame | None) -> Column:
    if isinstance(ref, int):
        if df is None:
            raise ValueError("an ordinal needs a DataFrame to resolve it")
        ref = df.columns[ref]
    return F.col(f"`{ref}`")


def _compile(x: Term | Node | None, df: DataFrame | None) -> Column:
    if x is None:
        return F.lit(True)
    if isinstance(x, Node):
        parts = [_compile(p, df) for p in x.parts]
        return ~parts[0] if x.kind == "not" else reduce(operator.and_ if x.kind == "and" else operator.or_, parts)
    c = _column(x.column, df)
    if x.kind in COMPARE:
        return COMPARE[x.kind](c, F.lit(x.value))
    if x.kind in ("is_null", "is_not_null"):
        return c.isNull() if x.kind == "is_null" else c.isNotNull()
    return c.isin(*x.value) if x.kind == "in" else ~c.isin(*x.value)


@dataclass(frozen=True)
class Predicate:
    """A built predicate; `tree` is None where every row matches."""

    tree: Term | Node | None
    program: tuple[str, ...] = ()

    def column(self, df: DataFrame | None = None) -> Column:
        return _compile(self.tree, df)

    def mask(self, df: DataFrame, name: str = "match") -> DataFrame:
        """df with a boolean column: the selection vector."""
        return df.withColumn(name, self.column(df))

    def terms(self) -> list[Term]:
        def walk(x):
            return [] if x is None else [x] if isinstance(x, Term) else [t for p in x.parts for t in walk(p)]

        return walk(self.tree)

    def columns(self, df: DataFrame | None = None) -> list[str]:
        return list(dict.fromkeys(df.columns[t.column] if isinstance(t.column, int) else t.column for t in self.terms()))


@dataclass
class PredicateBuilder:
    _stack: list = field(default_factory=list)
    _pending: str | None = None
    _program: list[str] = field(default_factory=list)

    def _term(self, kind: str, column: Ref, value: Any = None) -> PredicateBuilder:
        self._stack.append(Term(kind, column, value))
        self._program.append(f"{kind} {column}" + ("" if value is None else f" {value!r}"))
        if self._pending:
            self._join(self._pending)
            self._pending = None
        return self

    def _join(self, kind: str) -> None:
        right, left = self._stack.pop(), self._stack.pop()
        self._stack.append(Node(kind, (left, right)))
        self._program.append(kind)

    def _operator(self, kind: str) -> PredicateBuilder:
        if self._pending:
            raise ValueError(f"{kind} follows {self._pending}")
        if not self._stack:
            raise ValueError(f"{kind} needs a term before it")
        if len(self._stack) > 1:
            self._join(kind)  # after its terms
        else:
            self._pending = kind  # between its terms
        return self

    def eq(self, column: Ref, value: Any) -> PredicateBuilder:
        return self._term("eq", column, value)

    def ne(self, column: Ref, value: Any) -> PredicateBuilder:
        return self._term("ne", column, value)

    def lt(self, column: Ref, value: Any) -> PredicateBuilder:
        return self._term("lt", column, value)

    def le(self, column: Ref, value: Any) -> PredicateBuilder:
        return self._term("le", column, value)

    def gt(self, column: Ref, value: Any) -> PredicateBuilder:
        return self._term("gt", column, value)

    def ge(self, column: Ref, value: Any) -> PredicateBuilder:
        return self._term("ge", column, value)

    def is_null(self, column: Ref) -> PredicateBuilder:
        return self._term("is_null", column)

    def is_not_null(self, column: Ref) -> PredicateBuilder:
        return self._term("is_not_null", column)

    def in_(self, column: Ref, *values: Any) -> PredicateBuilder:
        return self._term("in", column, tuple(values))

    def not_in(self, column: Ref, *values: Any) -> PredicateBuilder:
        return self._term("not_in", column, tuple(values))

    def and_(self) -> PredicateBuilder:
        return self._operator("and")

    def or_(self) -> PredicateBuilder:
        return self._operator("or")

    def not_(self) -> PredicateBuilder:
        if self._pending or len(self._stack) != 1:
            raise ValueError("not needs one finished predicate before it")
        self._stack.append(Node("not", (self._stack.pop(),)))
        self._program.append("not")
        return self

    def build(self) -> Predicate:
        if self._pending:
            raise ValueError(f"{self._pending} needs a term after it")
        if len(self._stack) > 1:
            raise ValueError("two terms have no operator between them")
        return Predicate(self._stack[0] if self._stack else None, tuple(self._program))


def predicate() -> PredicateBuilder:
    return PredicateBuilder()


def make_eq(column: Ref, value: Any) -> Predicate:
    return predicate().eq(column, value).build()


def make_predicate(kind: str, column: Ref, value: Any = None) -> Predicate:
    """A predicate of one term."""
    if kind not in (*COMPARE, "is_null", "is_not_null", "in", "not_in"):
        raise ValueError(f"no predicate kind {kind}")
    return predicate()._term(kind, column, value).build()


def mask_and(a: Column, b: Column) -> Column:
    return a & b


def mask_or(a: Column, b: Column) -> Column:
    return a | b


def mask_not(a: Column) -> Column:
    return ~a


def count_true(df: DataFrame, mask: Column) -> DataFrame:
    """One row: n, the rows where the mask holds."""
    return df.agg(F.count_if(mask).alias("n"))
