"""Ordered work within keys of which a few may hold most rows: pieces of time, and what one piece hands to the next.

A key with many rows is cut into pieces by quantiles of its order values; a window never holds more than a piece.  What lies
before a piece comes to it in one of three ways: as a carried value (the last one, or a sum, of all pieces before),
as copied rows (the halo that a sliding window reaches back to), or as the composition of all pieces' functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opstables.operators.ranks import if_small
from opstables.sources.scratch import stored

#: Rows of a key from which on it is cut, and about as many a piece.
ROWS_A_PIECE = 1_000_000
#: Pieces of a key at most.
MOST_PIECES = 4096
#: Rows of a block, within which functions are composed by doubling.
ROWS_A_BLOCK = 1024


def _same(a: DataFrame, b: DataFrame, names: list[str], prefix: str = "_of_") -> Column:
    """Equal keys, nulls too; b has them under the prefix."""
    on = F.lit(True)
    for c in names:
        on = on & a[c].eqNullSafe(b[prefix + c])
    return on


def _join(rows: DataFrame, few: DataFrame, names: list[str]) -> DataFrame:
    """rows with the other columns of few (one row for each of names), where it has any."""
    other = few.select(*(F.col(c).alias(f"_of_{c}") if c in names else F.col(c) for c in few.columns))
    return rows.join(if_small(other), _same(rows, other, names), "left").drop(*(f"_of_{c}" for c in names))


@dataclass(frozen=True)
class Pieces:
    """rows, with `_piece` and `_cuts` (null for keys in one piece); most: rows of the largest key."""

    rows: DataFrame
    keys: list[str]
    at: str
    most: int

    @property
    def split(self) -> bool:
        return self.most > ROWS_A_PIECE

    def plain(self) -> DataFrame:
        return self.rows.drop("_piece", "_cuts")

    def _carry(self, ends: DataFrame, names: list[str], add: bool) -> DataFrame:
        """For each piece but a key's first: the sums, or last values, of the pieces before."""
        w = Window.partitionBy(*self.keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        before = (F.sum(n).over(w) if add else F.last(n, ignorenulls=True).over(w) for n in names)
        carried = ends.select(*self.keys, "_piece", *(x.alias(f"_before_{n}") for x, n in zip(before, names, strict=True)))
        return carried.where("_piece > 0")

    def last_before(self, order: list[str], values: dict[str, Column]) -> Pieces:
        """With the last value that isn't null on the rows before each (a struct keeps a null that counts)."""
        rows = self.rows.withColumns({f"_own_{n}": v for n, v in values.items()})
        w = Window.partitionBy(*self.keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = rows.withColumns({n: F.last(f"_own_{n}", ignorenulls=True).over(w) for n in values})
        if self.split:
            place = F.struct(*order)
            ends = stored(rows.where("_cuts IS NOT NULL").groupBy(*self.keys, "_piece").agg(*(F.max_by(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), place)).alias(n) for n in values)), "piece-ends")
            out = _join(out, self._carry(ends, list(values), False), [*self.keys, "_piece"])
            out = out.withColumns({n: F.coalesce(n, f"_before_{n}") for n in values}).drop(*(f"_before_{n}" for n in values))
        return replace(self, rows=out.drop(*(f"_own_{n}" for n in values)))

    def running_sum(self, order: list[str], values: dict[str, Column]) -> Pieces:
        """With the sum up to each row."""
        rows = self.rows.withColumns({f"_own_{n}": v for n, v in values.items()})
        w = Window.partitionBy(*self.keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumns({n: F.sum(f"_own_{n}").over(w) for n in values})
        if self.split:
            ends = stored(rows.where("_cuts IS NOT NULL").groupBy(*self.keys, "_piece").agg(*(F.sum(f"_own_{n}").alias(n) for n in values)), "piece-sums")
            out = _join(out, self._carry(ends, list(values), True), [*self.keys, "_piece"])
            out = out.withColumns({n: F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)) for n in values}).drop(*(f"_before_{n}" for n in values))
        return replace(self, rows=out.drop(*(f"_own_{n}" for n in values)))

    def with_halo(self, reach: float) -> Pieces:
        """With `_halo`: copies of the rows that a window of reach (in order values) has to see in later pieces.

        A row is copied to the pieces that its reach covers: once or twice, unless reach is longer than a piece.
        """
        if not self.split:
            return replace(self, rows=self.rows.withColumn("_halo", F.lit(False)))
        # piece p of a key has the values above _cuts[p - 1]
        last = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(self.at) + reach)), F.lit(0))
        last = F.when(F.col("_cuts").isNotNull(), F.greatest(last, F.col("_piece"))).otherwise(F.col("_piece"))
        own = F.col("_piece").alias("_home")
        rows = self.rows.select(*(c for c in self.rows.columns if c != "_piece"), own, F.explode(F.sequence(F.col("_piece"), last)).alias("_piece"))
        return replace(self, rows=rows.withColumn("_halo", F.col("_piece") != F.col("_home")).drop("_home"))

    def composed_before(self, order: list[str], element: Column, compose: Callable[[Column, Column], Column], identity: Column, name: str) -> Pieces:
        """With the composition of the elements of all rows before each, first to last; compose takes the earlier one first.

        In blocks of rows by doubling (each step composes with the row 1, 2, 4 ... before), then over a piece's blocks,
        then over a key's pieces: no step is longer than a block, or than the list of blocks or pieces.
        """
        piece = [*self.keys, "_piece"]
        rank = F.row_number().over(Window.partitionBy(*piece).orderBy(*order)) - 1
        rows = self.rows.withColumn("_rank", rank).withColumns({"_block": F.floor(F.col("_rank") / ROWS_A_BLOCK).cast("int"), name: element})
        block = Window.partitionBy(*piece, "_block").orderBy("_rank")
        for k in range(math.ceil(math.log2(max(1, min(ROWS_A_BLOCK, self.most))))):
            before = F.lag(name, 2**k).over(block)
            rows = rows.withColumn("_earlier", before).withColumn(name, F.when(F.col("_earlier").isNull(), F.col(name)).otherwise(compose(F.col("_earlier"), F.col(name)))).drop("_earlier")
        before = F.coalesce(F.lag(name).over(block), identity)
        if self.most <= ROWS_A_BLOCK and not self.split:
            return replace(self, rows=rows.withColumn(name, before).drop("_rank", "_block"))
        whole = stored(rows.groupBy(*piece, "_block").agg(F.max_by(name, "_rank").alias("_f")), "blocks")

        def all_before(by: list[str], at: str) -> Column:
            w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
            return F.aggregate(F.collect_list("_f").over(w), identity, compose)

        whole = whole.withColumn("_blocks", all_before(piece, "_block"))
        by_piece = whole.groupBy(*piece).agg(F.max_by(compose(F.col("_blocks"), F.col("_f")), "_block").alias("_f"))
        by_piece = by_piece.withColumn("_pieces", all_before(self.keys, "_piece")).drop("_f")
        starts = _join(whole.drop("_f"), by_piece, piece) if self.split else whole.drop("_f").withColumn("_pieces", identity)
        starts = starts.where("_block > 0 OR _piece > 0").select(*piece, "_block", compose(F.coalesce("_pieces", identity), F.col("_blocks")).alias("_start"))
        out = _join(rows.withColumn(name, before), starts, [*piece, "_block"])
        return replace(self, rows=out.withColumn(name, F.when(F.col("_start").isNull(), F.col(name)).otherwise(compose(F.col("_start"), F.col(name)))).drop("_rank", "_block", "_start"))


def pieces(df: DataFrame, keys: list[str], at: str) -> Pieces:
    """df in pieces by approximate quantiles of the number at; rows of equal values stay in one piece, those without in the first."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    if most <= ROWS_A_PIECE:
        return Pieces(df.withColumns({"_piece": F.lit(0), "_cuts": F.lit(None)}), keys, at, most)
    hot = stored(counts.where(F.col("_n") > ROWS_A_PIECE), "hot-keys")
    known = hot.select(*(F.col(c).alias(f"_of_{c}") for c in keys), "_n")
    n = min(MOST_PIECES, math.ceil(most / ROWS_A_PIECE))
    cuts = df.join(if_small(known), _same(df, known, keys)).groupBy(*keys).agg(F.approx_percentile(at, [i / n for i in range(1, n)], 10 * n).alias("_all"), F.max("_n").alias("_n"))
    # of n - 1 quantiles, as many as the key has rows for
    own = F.greatest(F.ceil(F.col("_n") / ROWS_A_PIECE), F.lit(2)).cast("int")
    own = F.least(own, F.lit(n))
    cuts = stored(cuts.select(*keys, F.array_distinct(F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.element_at("_all", F.greatest(F.lit(1), F.floor(i * n / own).cast("int"))))).alias("_cuts")), "cuts")
    rows = _join(df, cuts, keys)
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(at))), F.lit(0))
    return Pieces(rows.withColumn("_piece", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(piece)), keys, at, most)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: dict[str, str], name: str, after: bool = False) -> DataFrame:
    """left with the last row of right (one for each of its keys and times) at or before each, or the first at or after it: its time as name, and values (column of right -> new name); null if there is none.

    Both sides stand in one order, right rows first among equals; a piece has the last right row of the pieces before.
    """
    own = F.struct(*(F.col(c) for c in left.columns)).alias("_left")
    sign = -1 if after else 1
    rows = left.select(*keys, (F.col(at) * sign).alias("_at"), F.lit(1).alias("_side"), own)
    found = F.struct(F.col(right_at).alias("_time"), *(F.col(c).alias(new) for c, new in values.items())).alias("_right")
    marks = right.where(F.col(right_at).isNotNull()).select(*keys, (F.col(right_at) * sign).alias("_at"), F.lit(0).alias("_side"), found)
    both = rows.unionByName(marks, allowMissingColumns=True)
    seen = pieces(both, keys, "_at").last_before(["_at", "_side"], {"_seen": F.col("_right")}).plain().where("_side = 1")
    near = F.when(F.col("_at").isNotNull(), F.col("_seen"))
    return seen.select("_left.*", near["_time"].alias(name), *(near[new].alias(new) for new in values.values()))
