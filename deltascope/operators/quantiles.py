"""Exact medians without bringing a column, or a group, together in one place.

For a few columns of a table: a sketch proposes cut points around the wanted rank, an exact
count says between which of them the rank lies, and the search goes on inside that interval.
Each round narrows the interval by a factor of some thousands; when few enough rows are
left, they are sorted. Values that fill much of the column become cut points themselves and
end the search.

For any number of groups: their values are dealt out by ranges, and the rows of a group in
earlier ranges say in which range its middle lies and how far into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltascope.functions.text import present, quoted
from deltascope.sources.materialize import materialize

SORT_AT_MOST = 100_000
ACCURACY = 10_000
# how far around the wanted rank the cut points lie, as a share of the rows
MARGIN = 2 / ACCURACY


@dataclass
class _Search:
    """Looks for the values at `rank` (0-based) and after it; the first lies strictly between
    `low` and `high`, where `rows` values are left."""

    column: str
    rank: int
    rows: int
    low: float | None = None
    high: float | None = None
    lower: float | None = None
    upper: float | None = None
    cuts: list[float] | None = None

    def value(self, df: DataFrame) -> Column:
        return _number(df, self.column)

    def inside(self, df: DataFrame) -> Column:
        value, wanted = self.value(df), F.lit(True)
        if self.low is not None:
            wanted = wanted & (value > F.lit(self.low))
        if self.high is not None:
            wanted = wanted & (value < F.lit(self.high))
        return F.when(wanted, value)


def _number(df: DataFrame, column: str) -> Column:
    return F.when(present(df, column), F.col(quoted(column)).cast("double"))


def medians(df: DataFrame, columns: list[str], sort_at_most: int = SORT_AT_MOST) -> dict[str, float | None]:
    """Exact median per numeric column; None for a column without values.

    All columns advance together. The usual course is three aggregates: count and sketch,
    exact counts around the cut points, and the few values left, sorted.
    """
    if not columns:
        return {}
    middle = [0.5 - MARGIN, 0.5, 0.5 + MARGIN]
    first = df.agg(
        *[F.count(_number(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(_number(df, c), middle, ACCURACY).alias(f"cuts{i}") for i, c in enumerate(columns)],
    ).first()
    sizes = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    searches = [
        _Search(c, (sizes[c] - 1) // 2, sizes[c], cuts=first[f"cuts{i}"]) for i, c in enumerate(columns) if sizes[c]
    ]
    open_ = searches
    while open_:
        _finish(df, [s for s in open_ if s.rows <= sort_at_most], sort_at_most)
        _narrow(df, [s for s in open_ if s.lower is None])
        open_ = [s for s in open_ if s.lower is None]
    out: dict[str, float | None] = dict.fromkeys(columns)
    for s in searches:
        out[s.column] = s.lower if sizes[s.column] % 2 else (s.lower + s.upper) / 2
    return out


def group_medians(counts: DataFrame) -> DataFrame:
    """`(group, median)` of `(group, value, rows)`, exact, for any number of groups of any size."""
    return values_at(counts).select("group", ((F.col("lower") + F.col("upper")) / 2).alias("median"))


def values_at(counts: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """`(group, lower, upper)`: the values at two ranks of every group of `(group, value, rows)`.

    `ranks` has `(group, low, high)`, counted from 1; without it they are the middle ones.
    A rank beyond the end has no value. Values are dealt out by ranges of group and value and
    written; a group has one subtotal for each range it reaches into, and only ranges that
    hold a wanted rank are read again. Rows without a group are a group.
    """
    placed = materialize(counts.repartitionByRange("group", "value").withColumn("part", F.spark_partition_id()), "ranges")
    in_group = Window.partitionBy("group")
    earlier = in_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    reached = placed.groupBy("group", "part").agg(F.sum("rows").alias("here")).select(
        "group", "part", "here", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(in_group).alias("all")
    )
    if ranks is None:
        reached = reached.withColumn("low", F.floor((F.col("all") + 1) / 2)).withColumn("high", F.floor(F.col("all") / 2) + 1)
    else:
        named = ranks.withColumnRenamed("group", "_group")
        reached = reached.join(named, reached["group"].eqNullSafe(named["_group"])).drop("_group")
    wanted = reached.where((F.col("before") < F.col("high")) & (F.col("before") + F.col("here") >= F.col("low"))).select(
        F.col("group").alias("_group"), F.col("part").alias("_part"), "before", "low", "high"
    )
    near = placed.join(wanted, (placed["part"] == wanted["_part"]) & placed["group"].eqNullSafe(wanted["_group"]))
    upto = Window.partitionBy("group", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.col("before") + F.sum("rows").over(upto)
    return near.withColumn("seen", seen).groupBy("group").agg(
        F.min(F.when(F.col("seen") >= F.col("low"), F.col("value"))).alias("lower"),
        F.min(F.when(F.col("seen") >= F.col("high"), F.col("value"))).alias("upper"),
    )


def _finish(df: DataFrame, searches: list[_Search], sort_at_most: int) -> None:
    """Few enough values left: sort them, in one row if all of them together are few."""
    if not searches:
        return
    if sum(s.rows for s in searches) <= sort_at_most:
        lists = [F.array_sort(F.collect_list(s.inside(df))) for s in searches]
        row = df.agg(*[
            F.get(left, F.lit(s.rank + k)).alias(f"{end}{i}")
            for i, (left, s) in enumerate(zip(lists, searches)) for k, end in enumerate(("lower", "upper"))
        ]).first()
        for i, s in enumerate(searches):
            s.lower, s.upper = row[f"lower{i}"], row[f"upper{i}"]
    else:
        names = [str(i) for i in range(len(searches))]
        left = df.select(*[s.inside(df).alias(n) for n, s in zip(names, searches)]).unpivot([], names, "group", "value")
        ranks = df.sparkSession.createDataFrame([(n, s.rank + 1, s.rank + 2) for n, s in zip(names, searches)], "group string, low long, high long")
        counts = left.where(F.col("value").isNotNull()).groupBy("group", "value").agg(F.count("*").alias("rows"))
        for row in values_at(counts, ranks).collect():
            searches[int(row["group"])].lower, searches[int(row["group"])].upper = row["lower"], row["upper"]
    # where the wanted rank is the last one inside, the value after it lies beyond
    ends = [s for s in searches if s.upper is None and s.high is not None]
    if ends:
        row = df.agg(*[F.min(F.when(s.value(df) >= F.lit(s.high), s.value(df))).alias(f"e{i}") for i, s in enumerate(ends)]).first()
        for i, s in enumerate(ends):
            s.upper = row[f"e{i}"]


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    """Propose cut points around the rank, then count exactly what lies between them."""
    if not searches:
        return
    unsketched = [s for s in searches if s.cuts is None]
    if unsketched:
        proposals = []
        for i, s in enumerate(unsketched):
            share = (s.rank + 0.5) / s.rows
            around = [max(0.0, share - MARGIN), share, min(1.0, share + MARGIN)]
            proposals.append(F.percentile_approx(s.inside(df), around, ACCURACY).alias(f"cuts{i}"))
        row = df.agg(*proposals).first()
        for i, s in enumerate(unsketched):
            s.cuts = row[f"cuts{i}"]
    aggregates = []
    for i, s in enumerate(searches):
        s.cuts = sorted(set(s.cuts))
        inside, value = s.inside(df), s.value(df)
        for j, cut in enumerate(s.cuts):
            aggregates += [
                F.count_if(inside < F.lit(cut)).alias(f"less{i}_{j}"), F.count_if(inside == F.lit(cut)).alias(f"equal{i}_{j}"),
                F.min(F.when(value > F.lit(cut), value)).alias(f"beyond{i}_{j}"),
            ]
    row = df.agg(*aggregates).first()
    for i, s in enumerate(searches):
        low, high, passed, end = s.low, s.high, 0, s.rows
        for j, cut in enumerate(s.cuts):
            less, upto = row[f"less{i}_{j}"], row[f"less{i}_{j}"] + row[f"equal{i}_{j}"]
            if s.rank < less:
                high, end = cut, less
                break
            if s.rank < upto:
                s.lower = cut
                s.upper = cut if s.rank + 1 < upto else row[f"beyond{i}_{j}"]
                break
            low, passed = cut, upto
        s.low, s.high, s.rows, s.rank, s.cuts = low, high, end - passed, s.rank - passed, None
