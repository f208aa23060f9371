"""Conditions of graph steps over rows (I3): values that know when they can't be computed, so that a step is taken then."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NullType, NumericType, StringType, StructType

_NULL = NullType()


@dataclass(frozen=True)
class Term:
    """A value, its type, and where it has failed."""

    value: Column
    kind: DataType
    failed: Column

    def truth(self) -> Column:
        """Null, false, 0, and empty texts, lists and maps are false."""
        if isinstance(self.kind, NullType):
            return F.lit(False)
        if isinstance(self.kind, BooleanType):
            found = self.value
        elif isinstance(self.kind, NumericType):
            found = self.value != 0
        elif isinstance(self.kind, StringType):
            found = self.value != ""
        elif isinstance(self.kind, (ArrayType, MapType)):
            found = F.size(self.value) > 0
        else:
            found = self.value.isNotNull()
        return F.coalesce(found, F.lit(False))


def _comparable(a: DataType, b: DataType) -> bool:
    as_number = (NumericType, BooleanType)
    return type(a) is type(b) or isinstance(a, as_number) and isinstance(b, as_number)


def _plain(t: Term) -> Column:
    return t.value.cast("int") if isinstance(t.kind, BooleanType) else t.value


class Conditions:
    """Builds conditions over the rows of df: names (columns, and entries of maps and structs by dots), constants, comparisons, membership, and, or, not."""

    def __init__(self, df: DataFrame) -> None:
        self.schema = df.schema

    def constant(self, value: Any) -> Term:
        kind = _NULL if value is None else BooleanType() if isinstance(value, bool) else StringType() if isinstance(value, str) else None
        if isinstance(value, (list, tuple)):
            items = [x for x in value if x is not None]
            return Term(F.array(*map(F.lit, value)), ArrayType(self.constant(items[0]).kind if items else _NULL), F.lit(False))
        return Term(F.lit(value), kind or StructType.fromDDL("x double" if isinstance(value, float) else "x long")["x"].dataType, F.lit(False))

    def name(self, path: str) -> Term:
        """A name that isn't there is null; so is an entry that isn't.  An entry of what is no map (or null) fails."""
        first, *rest = path.split(".")
        if first not in self.schema.names:
            found = Term(F.lit(None), _NULL, F.lit(False))
        else:
            found = Term(F.col(f"`{first}`"), self.schema[first].dataType, F.lit(False))
        for key in rest:
            failed = found.failed | found.value.isNull()
            if isinstance(found.kind, MapType):
                found = Term(F.try_element_at(found.value, F.lit(key)), found.kind.valueType, failed)
            elif isinstance(found.kind, StructType):
                there = key in found.kind.names
                found = Term(found.value[key] if there else F.lit(None), found.kind[key].dataType if there else _NULL, failed)
            else:
                found = Term(F.lit(None), _NULL, F.lit(True))
        return found

    def _of(self, x: Any) -> Term:
        return x if isinstance(x, Term) else self.constant(x)

    def compare(self, a: Any, op: str, b: Any) -> Term:
        """== and != tell nulls and values of other kinds apart; <, <=, >, >= of these fail."""
        a, b = self._of(a), self._of(b)
        failed, alike = a.failed | b.failed, _comparable(a.kind, b.kind)
        if op in ("==", "!="):
            same = _plain(a).eqNullSafe(_plain(b)) if alike else a.value.isNull() & b.value.isNull()
            return Term(same if op == "==" else ~same, BooleanType(), failed)
        if not alike or isinstance(a.kind, NullType):
            return Term(F.lit(False), BooleanType(), F.lit(True))
        x, y = _plain(a), _plain(b)
        found = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return Term(F.coalesce(found, F.lit(False)), BooleanType(), failed | x.isNull() | y.isNull())

    def member(self, a: Any, b: Any, negated: bool = False) -> Term:
        """Whether a is in the list, among the map's keys, or part of the text b; false, negated too, if b is null or none of these."""
        a, b = self._of(a), self._of(b)
        fits = b.value.isNotNull()
        if isinstance(b.kind, ArrayType):
            alike = _comparable(a.kind, b.kind.elementType)
            hit = F.exists(b.value, lambda x: x.eqNullSafe(a.value)) if alike else F.exists(b.value, lambda x: x.isNull()) & a.value.isNull()
        elif isinstance(b.kind, MapType):
            hit = F.coalesce(F.map_contains_key(b.value, a.value), F.lit(False)) if _comparable(a.kind, b.kind.keyType) else F.lit(False)
        elif isinstance(b.kind, StringType) and isinstance(a.kind, StringType):
            hit, fits = F.contains(b.value, a.value), fits & a.value.isNotNull()
        else:
            hit, fits = F.lit(False), F.lit(False)
        return Term(F.coalesce((~hit if negated else hit) & fits, F.lit(False)), BooleanType(), a.failed | b.failed)

    def every(self, *terms: Any) -> Term:
        return self._joined(and_, terms)

    def some(self, *terms: Any) -> Term:
        return self._joined(or_, terms)

    def _joined(self, how: Any, terms: tuple) -> Term:
        """All terms are computed, so any of them that fails fails the whole."""
        found = [self._of(t) for t in terms]
        return Term(reduce(how, (t.truth() for t in found)), BooleanType(), reduce(or_, (t.failed for t in found)))

    def negated(self, term: Any) -> Term:
        t = self._of(term)
        return Term(~t.truth(), BooleanType(), t.failed)
