"""Profiling: what kind of column each one is, and what is wrong with it.

Everything follows from a table of cells: the distinct values of all columns with their row
counts, and what the rules ask of each value, worked out once per distinct value rather than
once per row. It is written by one scan of the source; facts, commonest and smallest values,
means, deviations and medians are aggregates of it. The source is read again only for long
texts, of which a cell has no more than a digest, and to look for repeated rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

from deltascope.functions import fixed
from deltascope.functions.text import as_text, clean_text, is_datetime, is_floating, plain_number, present, quoted, strip
from deltascope.functions.time import parse_trimmed_dates
from deltascope.operators.duplicates import count_duplicates
from deltascope.operators.quantiles import group_medians
from deltascope.sources.materialize import materialize

NOTES = {
    "empty": "no value at all",
    "year": "a whole-number year: a time axis, not something to sum",
    "identifier_number": "a number that reads as an identifier: do not sum it",
    "date_as_string": "dates stored as text: parse before use",
    "numeric_as_string": "numbers stored as text: strip $ , % and cast before summing",
    "boolean_text": "yes/no stored as text: fold before filtering",
}


@dataclass(frozen=True)
class ColumnProfile:
    position: int
    name: str
    dtype: str
    semantic_type: str
    null_count: int
    null_pct: float
    unique_count: int
    samples: list[str] = field(default_factory=list)
    top_values: list[tuple[str, int]] = field(default_factory=list)
    min: str | None = None
    max: str | None = None
    mean: float | None = None
    median: float | None = None
    std: float | None = None
    has_negatives: bool = False
    zero_count: int = 0
    note: str | None = None

    @property
    def code_named(self) -> bool:
        return re.search(fixed.CODE_NAME_PATTERN, self.name) is not None


PROFILE_SCHEMA = (
    "position int, name string, dtype string, semantic_type string, null_count bigint, null_pct double,"
    " unique_count bigint, samples array<string>, top_values array<struct<value: string, n: bigint>>,"
    " min string, max string, mean double, median double, std double, has_negatives boolean,"
    " zero_count bigint, note string"
)


@dataclass
class TableProfile:
    """One row per column plus facts about the table. As large as the schema, so it is local."""

    spark: SparkSession
    n_rows: int
    columns: list[ColumnProfile]
    duplicate_rows: int | None
    exact: bool = True

    def __getitem__(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def of_type(self, *semantic_types: str) -> list[str]:
        return [c.name for c in self.columns if c.semantic_type in semantic_types]

    @property
    def candidate_keys(self) -> list[str]:
        """Columns without nulls in which every row differs; provable only by exact counts."""
        if not self.exact or not self.n_rows:
            return []
        return [c.name for c in self.columns if c.null_count == 0 and c.unique_count == self.n_rows]

    @property
    def warnings(self) -> list[tuple[str, str]]:
        """`(kind, text)` of everything worth knowing before using the table."""
        return [*self._table_warnings(), *(w for c in self.columns for w in _column_warnings(c))]

    def _table_warnings(self):
        if not self.n_rows:
            yield "empty_table", "the table has no rows"
        if self.duplicate_rows:
            yield "duplicates", f"{self.duplicate_rows:,} repeated rows, {100 * self.duplicate_rows / self.n_rows:.1f}% of all"
        unnamed = sum(name.lower().startswith("unnamed:") for name in self.names)
        if unnamed:
            yield "unnamed", f"{unnamed} column(s) without a name, probably left over from a spreadsheet"

    def to_frame(self) -> DataFrame:
        return self.spark.createDataFrame(
            [tuple(getattr(c, f) for f in _FIELDS) for c in self.columns], PROFILE_SCHEMA
        )

    def table_frame(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(self.n_rows, len(self.columns), self.duplicate_rows, self.candidate_keys)],
            "n_rows bigint, n_cols int, duplicate_rows bigint, candidate_keys array<string>",
        )

    def warnings_frame(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(i, kind, text) for i, (kind, text) in enumerate(self.warnings, 1)],
            "position int, kind string, warning string",
        )

    def summary(self, source: str = "table") -> str:
        """The profile as compact text."""
        lines = [
            f"{source}: {self.n_rows:,} rows, {len(self.columns)} columns, "
            + ("duplicates not counted" if self.duplicate_rows is None else f"{self.duplicate_rows:,} duplicated rows")
        ]
        for c in self.columns:
            lines.append(f"  {c.name} [{c.semantic_type}, {c.dtype}] nulls {c.null_count} ({c.null_pct}%), {c.unique_count:,} distinct")
            if c.top_values:
                lines.append("    top: " + ", ".join(f"{v} ({n:,})" for v, n in c.top_values))
            figures = [(k, getattr(c, k)) for k in ("min", "max", "mean", "median", "std")]
            if any(v is not None for _, v in figures):
                lines.append("    " + ", ".join(f"{k} {v}" for k, v in figures if v is not None))
            if c.samples:
                lines.append("    e.g. " + " | ".join(c.samples))
            if c.note:
                lines.append(f"    note: {c.note}")
        if self.candidate_keys:
            lines.append("keys: " + ", ".join(self.candidate_keys))
        lines += [f"warning: {text}" for _, text in self.warnings]
        return "\n".join(lines)


_FIELDS = [f.split()[0] for f in re.sub(r"<[^>]*>+", "", PROFILE_SCHEMA).split(", ")]


def _column_warnings(c: ColumnProfile):
    if c.semantic_type == "empty":
        yield "all_null", f"'{c.name}' is entirely null"
    elif c.null_pct > 50:
        yield "mostly_null", f"'{c.name}' is {c.null_pct}% null"
    if c.semantic_type in ("date_as_string", "numeric_as_string"):
        yield "stored_as_text", f"'{c.name}' holds {'dates' if c.semantic_type[0] == 'd' else 'numbers'} as text"
    if rollup_levels(c):
        shown = ", ".join(v for v, _ in c.top_values[:3])
        yield "rollup", f"'{c.name}' names levels of aggregation ({shown}): rows are probably nested, and a sum over all levels double-counts"


def rollup_levels(column: ColumnProfile) -> bool:
    """Do the commonest values name levels of aggregation rather than peers?"""
    if column.semantic_type != "categorical" or not column.top_values:
        return False
    levels = sum(re.search(fixed.ROLLUP_PATTERN, value) is not None for value, _ in column.top_values)
    return levels >= max(1, len(column.top_values) // 2)


# ---------------------------------------------------------------- distinct values

# Columns with at most this many distinct values have their values listed outright; those of
# the others are found by a search. Both give the same values.
LISTED_DISTINCT = 1_000
# Longer texts are grouped by a digest, so that whole documents need not be shuffled.
DIGEST_ABOVE = 256
# Texts are bounded by so many of their first characters when the smallest are searched for.
BOUND_CHARACTERS = 64
# How many columns are unpivoted together.
COLUMNS_AT_ONCE = 100
# Into how many groups a longer column is split to bound its smallest values.
SAMPLE_GROUPS = 8


def _family(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.IntegralType, T.BooleanType)) or is_datetime(data_type):
        return "whole"
    return "floating" if is_floating(data_type) else "text"


def _cell(df: DataFrame, name: str) -> Column:
    """A value in the form its family is grouped in: eight bytes wherever possible."""
    column, data_type = F.col(quoted(name)), df.schema[name].dataType
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("bigint")
    if is_datetime(data_type):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("bigint")
    if isinstance(data_type, T.IntegralType):
        return column.cast("bigint")
    if is_floating(data_type):
        return F.when(~F.isnan(column), column.cast("double") + F.lit(0.0))
    return as_text(df, name)


def _text_of(data_type: T.DataType, cell: Column) -> Column:
    if isinstance(data_type, T.DateType):
        return F.date_from_unix_date(cell.cast("int")).cast("string")
    if is_datetime(data_type):
        return F.timestamp_micros(cell).cast("string")
    if isinstance(data_type, T.BooleanType):
        return (cell == 1).cast("string")
    if isinstance(data_type, T.FloatType):
        return cell.cast("float").cast("string")
    return cell.cast("string")


def _number_of(data_type: T.DataType, cell: Column) -> Column:
    if isinstance(data_type, (T.IntegralType, T.DoubleType, T.FloatType)):
        return cell.cast("double")
    return plain_number(cell) if isinstance(data_type, (T.StringType, T.DecimalType)) else F.lit(None).cast("double")


def _by_type(types: dict[int, T.DataType], rule) -> Column:
    """`rule(type)` for the rows of each position; positions of one type share a branch."""
    branches: dict[T.DataType, list[int]] = {}
    for position, data_type in types.items():
        branches.setdefault(data_type, []).append(position)
    chosen = None
    for data_type, positions in branches.items():
        column, here = rule(data_type), F.col("position").isin(positions)
        chosen = F.when(here, column) if chosen is None else chosen.when(here, column)
    return chosen if len(branches) > 1 else rule(next(iter(branches)))


def _families(df: DataFrame, columns: list[str]):
    """Columns of one family of types each, not too many at once, with their positions."""
    where = {name: i for i, name in enumerate(df.columns)}
    for family in ("whole", "floating", "text"):
        members = [c for c in columns if _family(df.schema[c].dataType) == family]
        for start in range(0, len(members), COLUMNS_AT_ONCE):
            some = members[start:start + COLUMNS_AT_ONCE]
            flat = df.select(*[_cell(df, c).alias(str(where[c])) for c in some])
            flat = flat.unpivot([], [str(where[c]) for c in some], "position", "cell")
            yield family, {where[c]: df.schema[c].dataType for c in some}, flat.withColumn("position", F.col("position").cast("int"))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`(position, value, place, rows)`: distinct values per column as text, with the number
    they sort by if they have one."""
    cell = F.col("cell")

    def place(family: str, data_type: T.DataType) -> Column:
        if isinstance(data_type, T.StringType):
            return F.lit(None).cast("double")
        return _number_of(data_type, cell) if family == "text" else cell.cast("double")

    parts = [
        flat.groupBy("position", "cell").agg(F.count("*").alias("rows")).select(
            "position", _by_type(types, lambda t: _text_of(t, cell)).alias("value"),
            _by_type(types, lambda t: place(family, t)).alias("place"), "rows",
        )
        for family, types, flat in _families(df, df.columns if columns is None else columns)
    ]
    return reduce(DataFrame.unionByName, parts)


def _first(counts: DataFrame, n: int, *order: Column) -> DataFrame:
    # Missing values sort last and are dropped after ranking: dropped before, the filter
    # would sink below the aggregate, and two rankings would no longer share one shuffle.
    # The rank limit is applied within each task before anything moves.
    window = Window.partitionBy("position").orderBy(F.col("value").isNull(), *order)
    ranked = counts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
    return ranked.filter(F.col("value").isNotNull()).select("position", "rank", "value", "rows")


def top_values(counts: DataFrame, n: int = fixed.TOP_VALUES) -> DataFrame:
    """The `n` commonest values per column: `(position, rank, value, rows)`."""
    return _first(counts, n, F.desc("rows"), F.asc("value"), F.asc("place"))


def sample_values(counts: DataFrame, n: int = fixed.SAMPLE_VALUES) -> DataFrame:
    """The `n` smallest values per column."""
    return _first(counts, n, F.asc("place"), F.asc("value"), F.asc("rows"))


def smallest_values(df: DataFrame, columns: list[str], n: int = fixed.SAMPLE_VALUES) -> DataFrame:
    """The `n` smallest distinct values of columns with very many, without sorting them.

    The values of a column are split into groups by hash. The `n`-th smallest of the groups'
    minima, which are all different, cannot lie below the `n`-th smallest value; so only
    values up to it are counted, and those are few. Of texts only the first characters are
    compared with the bound: no whole text comes to the driver for it.
    """
    values = [F.when(present(df, name), F.col(quoted(name))) for name in columns]
    is_text = [isinstance(df.schema[name].dataType, T.StringType) for name in columns]
    bounded = [F.substring(v, 1, BOUND_CHARACTERS) if t else v for v, t in zip(values, is_text)]
    # the hash is worked out once per value, below the aggregate
    hashed = df.select(*[
        part for i, value in enumerate(values)
        for part in (bounded[i].alias(f"v{i}"), F.pmod(F.xxhash64(value), F.lit(SAMPLE_GROUPS)).alias(f"g{i}"))
    ])
    minima = hashed.agg(*[
        F.min(F.when(F.col(f"g{i}") == group, F.col(f"v{i}"))).alias(f"m{i}_{group}")
        for i in range(len(columns)) for group in range(SAMPLE_GROUPS)
    ])
    row, limited = minima.first(), []
    for i, name in enumerate(columns):
        found = sorted(v for v in (row[f"m{i}_{g}"] for g in range(SAMPLE_GROUPS)) if v is not None)
        column = values[i]
        if len(found) >= n:
            column = F.when(bounded[i] <= F.lit(found[n - 1]).cast(df.schema[name].dataType), column)
        limited.append(column.alias(name))
    where = {name: i for i, name in enumerate(df.columns)}
    ranked = sample_values(value_counts(df.select(*limited)), n)
    position = F.create_map(*[F.lit(x) for i, name in enumerate(columns) for x in (i, where[name])])
    return ranked.withColumn("position", position[F.col("position")])


# ---------------------------------------------------------------- kinds of columns


FACTS = ("number", "characters", "is_date", "is_amount", "is_flag")


def _cells(df: DataFrame, exact: bool) -> DataFrame:
    """`(position, rows, instant, number, text, long, characters, is_date, is_amount, is_flag,
    present, mark)`: one row per distinct value and column, null being a value, or one per
    cell when counts need not be exact.

    Each family of types is grouped by itself, so that numbers and times stay eight bytes;
    together they read every column once. A long text is grouped by its digest, so its facts
    are worked out before the digest takes its place; those of a short one afterwards, once
    per distinct value. The rules are the same for both. Of a long text `text` has the first
    characters only. The rules read a text trimmed, so a long text that is short once trimmed,
    such as a padded cell, carries its trimmed text instead and has its facts worked out once
    per distinct value as well.
    """
    cell, parts = F.col("cell"), []
    for family, types, flat in _families(df, df.columns):
        key, carried = ["position", "cell"], []
        if family == "text":
            is_long, facts, trimmed = F.length(cell) > DIGEST_ABOVE, _text_facts(cell, types), strip(cell)
            padded = is_long & (F.length(trimmed) <= DIGEST_ABOVE)
            # a short text could look like a digest, so which it is belongs to the key
            key, carried = [*key, "long"], ["begins", "trimmed", *FACTS]
            flat = flat.select(
                "position", F.when(is_long, F.sha2(cell, 256)).otherwise(cell).alias("cell"),
                F.coalesce(is_long, F.lit(False)).alias("long"), F.when(is_long, F.substring(cell, 1, BOUND_CHARACTERS)).alias("begins"),
                F.when(padded, trimmed).alias("trimmed"), *[F.when(is_long & ~padded, facts[n]).alias(n) for n in FACTS],
            )
        if exact:
            flat = flat.groupBy(*key).agg(F.count("*").alias("rows"), *[F.max(n).alias(n) for n in carried])
        else:
            flat = flat.withColumn("rows", F.lit(1).cast("bigint"))
        if family == "text":
            # the facts of a text are those of its trimmed text
            of_trimmed = _text_facts(F.col("trimmed"), types)
            facts = [
                F.when(F.col("trimmed").isNotNull(), of_trimmed[n]).when(F.col("long"), F.col(n)).otherwise(facts[n]).alias(n)
                for n in FACTS
            ]
            text, long = F.when(F.col("long"), F.col("begins")).otherwise(cell), F.col("long")
        else:
            no, none = F.lit(False), F.lit(None)
            typed = (_by_type(types, lambda t: _number_of(t, cell)), none.cast("int"), no, none.cast("boolean"), none.cast("boolean"))
            facts = [c.alias(n) for n, c in zip(FACTS, typed)]
            text, long = none.cast("string"), no
        parts.append(flat.select(
            "position", "rows", (cell if family == "whole" else F.lit(None).cast("bigint")).alias("instant"), text.alias("text"),
            long.alias("long"), *facts, cell.isNotNull().alias("present"), F.xxhash64(cell).alias("mark"),
        ))
    found = reduce(DataFrame.unionByName, parts)
    return materialize(found, "cells") if exact else found


def _text_facts(cell: Column, types: dict[int, T.DataType]) -> dict[str, Column]:
    """What the rules ask of a text; null where it is missing or stands for missing."""
    clean = _by_type(types, lambda t: clean_text(cell) if isinstance(t, T.StringType) else F.lit(None).cast("string"))
    return {
        "number": _by_type(types, lambda t: _number_of(t, cell)),
        "characters": F.length(clean),
        "is_date": parse_trimmed_dates(clean).isNotNull(),
        "is_amount": clean.rlike(fixed.AMOUNT_PATTERN),
        "is_flag": F.lower(clean).isin(*fixed.BOOLEAN_WORDS),
    }


def _facts(cells: DataFrame, exact: bool) -> DataFrame:
    """Facts about the values of each column, weighted by rows: one row per column.

    All of these are hash aggregates on fixed-width buffers, combined before anything moves.
    """
    rows = F.col("rows")

    def weigh(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0))

    if exact:
        unique = F.count_if("present")
    else:
        unique = F.approx_count_distinct(F.when(F.col("present"), F.col("mark")), 0.01)
    return cells.groupBy("position").agg(
        F.sum("rows").alias("n_rows"),
        weigh(F.col("present")).alias("non_null"),
        unique.alias("unique_count"),
        F.min("instant").alias("min_instant"),
        F.max("instant").alias("max_instant"),
        F.min("number").alias("min_number"),
        F.max("number").alias("max_number"),
        weigh(F.col("number").isNotNull()).alias("n_numbers"),
        F.coalesce(F.bool_and(F.col("number") % 1 == 0), F.lit(False)).alias("all_whole"),
        weigh(F.col("characters").isNotNull()).alias("n_clean"),
        weigh(F.col("is_date")).alias("n_dates"),
        weigh(F.col("is_amount")).alias("n_amounts"),
        F.coalesce(F.bool_and("is_flag"), F.lit(False)).alias("all_flags"),
        F.sum(F.col("characters") * rows).alias("characters"),
        F.sum(F.col("number") * rows).alias("total"),
        weigh(F.col("number") == 0).alias("zero_count"),
        F.coalesce(F.max(F.col("number") < 0), F.lit(False)).alias("has_negatives"),
        F.bool_or("long").alias("has_long"),
    )


def _kind(data_type: T.DataType) -> str:
    if is_datetime(data_type):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "number" if isinstance(data_type, T.NumericType) else "text"


def semantic_type() -> Column:
    """The kind of a column, from its facts. The first rule that fits decides."""
    c = F.col
    unique, non_null, clean = c("unique_count"), c("non_null"), c("n_clean")
    mostly_unique = unique > fixed.KEY_MIN_RATIO * non_null
    span = c("max_number") - c("min_number") + 1
    year = (
        unique.between(2, fixed.YEAR_MAX_DISTINCT)
        & (c("n_numbers") >= 0.99 * non_null) & c("all_whole")
        & (c("min_number") >= fixed.YEAR_MIN) & (c("max_number") <= fixed.YEAR_MAX)
        & (c("year_named") | ((unique >= 3) & (span <= 2 * unique)))
    )
    few = (unique <= fixed.CATEGORY_MAX_DISTINCT) | (unique <= fixed.CATEGORY_MAX_RATIO * non_null)
    return (
        F.when(non_null == 0, "empty")
        .when(unique == 1, "constant")
        .when(c("kind") == "datetime", "date")
        .when(c("kind") == "boolean", "boolean")
        .when(year, "year")
        .when((c("kind") == "number") & c("code_named") & mostly_unique, "identifier")
        .when(c("kind") == "number", "numeric")
        .when((clean > 0) & (c("n_dates") >= fixed.TYPE_SHARE * clean), "date_as_string")
        .when((clean > 0) & (c("n_amounts") >= fixed.TYPE_SHARE * clean), "numeric_as_string")
        .when(c("all_flags"), "boolean")
        .when(mostly_unique & (c("code_named") | (unique > fixed.KEY_MIN_DISTINCT)), "identifier")
        .when(c("characters") >= fixed.FREE_TEXT_MIN_LENGTH * clean, F.when(clean > 0, "free_text").otherwise("categorical"))
        .when(few, "categorical")
        .otherwise("free_text")
    )


def _note(row: Row, samples: list[str]) -> str | None:
    semantic, kind = row["semantic_type"], row["kind"]
    if semantic == "constant":
        return f"single value: {samples[0]}"
    if semantic == "identifier" and kind == "number":
        return NOTES["identifier_number"]
    if semantic == "numeric" and row["code_named"]:
        return (
            f"a code by its name, with {row['unique_count']:,} distinct values:"
            " rather a category, not a quantity to sum"
        )
    if semantic == "boolean" and kind == "text":
        return NOTES["boolean_text"]
    return NOTES.get(semantic)


def profile(df: DataFrame, exact: bool = True, duplicates: bool = True) -> TableProfile:
    """Profile every column and the table.

    With `exact=False` distinct counts are estimated and only the values of categories are
    shuffled: a screening run. Keys cannot be proven then, and duplicates are not counted.
    """
    spark, fields = df.sparkSession, df.schema.fields
    meta = spark.createDataFrame(
        [
            (i, f.name, f.dataType.simpleString(), _kind(f.dataType),
             re.search(fixed.CODE_NAME_PATTERN, f.name) is not None,
             re.search(fixed.YEAR_NAME_PATTERN, f.name) is not None)
            for i, f in enumerate(fields)
        ],
        "position int, name string, dtype string, kind string, code_named boolean, year_named boolean",
    )
    if not fields:
        return TableProfile(spark, 0, [], None, exact)
    cells = _cells(df, exact)
    columns = meta.join(_facts(cells, exact), "position", "left").fillna(0, ["n_rows", "non_null", "unique_count", "n_clean"])
    columns = columns.withColumn("semantic_type", semantic_type())
    for end in ("min", "max"):
        instant = F.col(f"{end}_instant")
        columns = columns.withColumn(
            f"{end}_time",
            F.when(F.col("dtype") == "date", _text_of(T.DateType(), instant)).otherwise(_text_of(T.TimestampType(), instant)),
        )
    rows = columns.orderBy("position").collect()
    numeric = [r for r in rows if r["semantic_type"] == "numeric"]
    if exact:
        values, figures = _values(df, cells, rows), _figures(cells, numeric)
    else:
        values, figures = _screened_values(df, rows), estimated_figures(df, [r["name"] for r in numeric])
    n_rows = max((r["n_rows"] for r in rows), default=0)
    profiles = [_column(r, n_rows, values, figures.get(r["name"], {})) for r in rows]
    table = TableProfile(spark, n_rows, profiles, None, exact)
    if duplicates and exact:
        # a table with a key cannot hold two equal rows
        table.duplicate_rows = 0 if table.candidate_keys or not n_rows else count_duplicates(df)
    return table


def candidate_keys(df: DataFrame) -> list[str]:
    """The columns an exact profile calls keys: no nulls, and every row differs.

    Only the counts the rule reads are taken, all in one pass; a long text is counted by its
    digest, as the profile does.
    """
    if not df.columns or df.isStreaming:
        return []
    counts = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema.fields):
        cell = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            long = F.length(cell) > DIGEST_ABOVE
            distinct = F.count_distinct(F.when(long, F.sha2(cell, 256)).otherwise(cell), long)
        else:
            distinct = F.count_distinct(cell)
        counts += [F.count(cell).alias(f"present_{i}"), distinct.alias(f"unique_{i}")]
    row = df.agg(*counts).first()
    n = row["n"]
    return [f.name for i, f in enumerate(df.schema.fields) if n and row[f"present_{i}"] == n and row[f"unique_{i}"] == n]


Values = dict[tuple[str, int], list[Row]]  # the commonest ("top") and smallest ("samples") values by position


def _gathered(top: DataFrame | None, samples: DataFrame | None) -> Values:
    """A handful of rows per column, in order."""
    parts = [frame.withColumn("part", F.lit(name)) for name, frame in (("top", top), ("samples", samples)) if frame is not None]
    found: Values = {}
    if parts:
        for v in sorted(reduce(DataFrame.unionByName, parts).collect(), key=lambda v: v["rank"]):
            found.setdefault((v["part"], v["position"]), []).append(v)
    return found


def _values(df: DataFrame, cells: DataFrame, rows: list[Row]) -> Values:
    """The commonest values of categories and the smallest of all columns, from the cells.

    Columns that hold long texts take one more scan, for all of them together: their smallest
    values cannot begin later than the smallest cells do.
    """
    types = {r["position"]: df.schema[r["name"]].dataType for r in rows}

    def value(data_type: T.DataType) -> Column:
        family = _family(data_type)
        return F.col("text") if family == "text" else _text_of(data_type, F.col("instant" if family == "whole" else "number"))

    place = F.when(F.col("position").isin([i for i, t in types.items() if not isinstance(t, T.StringType)]), F.coalesce(F.col("instant").cast("double"), "number"))
    counts = cells.select("position", _by_type(types, value).alias("value"), place.alias("place"), "rows")
    ranked = [r["position"] for r in rows if r["semantic_type"] in RANKED]
    long = [r for r in rows if r["has_long"]]
    brief = [i for i in ranked if i not in {r["position"] for r in long}]
    found = _gathered(top_values(counts.where(F.col("position").isin(brief))) if brief else None, sample_values(counts))
    if not long:
        return found
    limited = []
    for r in long:
        column, smallest = as_text(df, r["name"]), found.get(("samples", r["position"]), [])
        if r["position"] not in ranked and len(smallest) == fixed.SAMPLE_VALUES:
            bound = smallest[-1]["value"][:BOUND_CHARACTERS]
            column = F.when(F.substring(column, 1, BOUND_CHARACTERS) <= F.lit(bound), column)
        limited.append(column.alias(r["name"]))
    whole = materialize(value_counts(df.select(*limited)), "long-values")
    home = F.create_map(*[F.lit(x) for i, r in enumerate(long) for x in (i, r["position"])])
    whole = whole.withColumn("position", home[F.col("position")])
    top = [i for i in ranked if i not in brief]
    return found | _gathered(top_values(whole.where(F.col("position").isin(top))) if top else None, sample_values(whole))


def _screened_values(df: DataFrame, rows: list[Row]) -> Values:
    """The same without a table of cells.

    Commonest values are counted only for columns that are categories, and the smallest ones
    of long columns come from a search that does not sort them.
    """
    listed = [r["name"] for r in rows if 0 < r["unique_count"] <= LISTED_DISTINCT]
    long = [r["name"] for r in rows if r["unique_count"] > LISTED_DISTINCT]
    ranked = [r["name"] for r in rows if r["semantic_type"] in RANKED]
    counts = value_counts(df, listed) if listed else None
    samples = [f for f in (sample_values(counts) if listed else None, smallest_values(df, long) if long else None) if f is not None]
    top = [top_values(c) for c in (counts, value_counts(df, [c for c in ranked if c in long]) if set(ranked) & set(long) else None) if c is not None]
    return _gathered(reduce(DataFrame.unionByName, top) if top else None, reduce(DataFrame.unionByName, samples) if samples else None)


RANKED = ("categorical", "boolean")


def _figures(cells: DataFrame, numeric: list[Row]) -> dict[str, dict]:
    """Figures of numeric columns: most are facts already, deviations and medians follow from the cells."""
    if not numeric:
        return {}
    means = {r["position"]: r["total"] / r["n_numbers"] for r in numeric}
    mean = F.create_map(*[F.lit(x) for p, m in means.items() for x in (p, m)])[F.col("position")]
    numbers = cells.where(F.col("position").isin(list(means)) & F.col("number").isNotNull()).select("position", "number", "rows")
    squares = numbers.groupBy("position").agg(F.sum(F.pow(F.col("number") - mean, 2) * F.col("rows")).alias("squares"))
    medians = group_medians(numbers.select(F.col("position").alias("group"), F.col("number").alias("value"), "rows"))
    spread = {r["position"]: r["squares"] for r in squares.collect()}
    middle = {r["group"]: r["median"] for r in medians.collect()}
    return {
        r["name"]: {
            "min": r["min_number"], "max": r["max_number"], "mean": means[r["position"]], "median": middle[r["position"]],
            "std": (spread[r["position"]] / (r["n_numbers"] - 1)) ** 0.5 if r["n_numbers"] > 1 else None,
            "zero_count": r["zero_count"], "has_negatives": r["has_negatives"],
        }
        for r in numeric
    }


def estimated_figures(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Figures of numeric columns in one aggregate without a shuffle of rows; the median is estimated."""
    if not columns:
        return {}
    aggregates = []
    for i, name in enumerate(columns):
        value = F.when(present(df, name), F.col(quoted(name)).cast("double"))
        aggregates += [
            F.min(value).alias(f"min_{i}"), F.max(value).alias(f"max_{i}"), F.avg(value).alias(f"mean_{i}"),
            F.stddev_samp(value).alias(f"std_{i}"), F.count_if(value == 0).alias(f"zero_count_{i}"),
            F.coalesce(F.max(value < 0), F.lit(False)).alias(f"has_negatives_{i}"), F.percentile_approx(value, 0.5).alias(f"median_{i}"),
        ]
    row = df.agg(*aggregates).first()
    names = ("min", "max", "mean", "std", "median", "zero_count", "has_negatives")
    return {column: {n: row[f"{n}_{i}"] for n in names} for i, column in enumerate(columns)}


def _rounded(value) -> float | None:
    return None if value is None else round(float(value), 4)


def _column(row: Row, n_rows: int, values: Values, figures: dict) -> ColumnProfile:
    semantic = row["semantic_type"]
    samples = [v["value"] for v in values.get(("samples", row["position"]), [])]
    low = high = None
    if semantic == "numeric":
        low, high = (None if figures[k] is None else repr(_rounded(figures[k])) for k in ("min", "max"))
    elif semantic == "date":
        low, high = row["min_time"], row["max_time"]
    elif semantic == "year":
        low, high = str(int(row["min_number"])), str(int(row["max_number"]))
    nulls = n_rows - row["non_null"]
    top = [(v["value"], v["rows"]) for v in values.get(("top", row["position"]), [])] if semantic in RANKED else []
    return ColumnProfile(
        position=row["position"], name=row["name"], dtype=row["dtype"], semantic_type=semantic,
        null_count=nulls, null_pct=round(100 * nulls / n_rows, 2) if n_rows else 0.0,
        unique_count=row["unique_count"], samples=samples, top_values=top,
        min=low, max=high, mean=_rounded(figures.get("mean")), median=_rounded(figures.get("median")),
        std=_rounded(figures.get("std")),
        has_negatives=figures.get("has_negatives", False), zero_count=figures.get("zero_count", 0), note=_note(row, samples),
    )
