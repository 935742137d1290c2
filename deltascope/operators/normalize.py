"""Folding spellings of one category together, with a report of what was folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltascope.functions import fixed
from deltascope.functions.text import as_text, category_key, quoted, strip
from deltascope.sources.materialize import materialize

# Into how many parts the rows of one category are dealt for a lookup that is not broadcast.
PARTS = 16


def spelling_counts(df: DataFrame, columns: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """`(dimension, spelling, rows, <sums>)`: one row per distinct trimmed spelling.

    All dimensions share one scan and one shuffle. The unpivoted rows are combined map-side,
    so what is shuffled is spellings, not rows, and a spelling that fills a third of the
    table arrives as one partial row per task.
    """
    sums = sums or {}
    names = {c: f"d{i}" for i, c in enumerate(columns)}
    flat = df.select(
        *[strip(as_text(df, c)).alias(names[c]) for c in columns],
        *[value.alias(name) for name, value in sums.items()],
    )
    dimension = F.create_map(*[F.lit(x) for c in columns for x in (names[c], c)])
    return (
        flat.unpivot(list(sums), list(names.values()), "dimension", "spelling")
        .groupBy("dimension", "spelling")
        .agg(F.count("*").alias("rows"), *[F.sum(name).alias(name) for name in sums])
        .withColumn("dimension", dimension[F.col("dimension")])
    )


def fold(spellings: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """`(dimension, key, segment, rows, <sums>, spellings)`: one row per category.

    The label is the commonest spelling; among equally common ones the smallest.
    """
    named = F.when(F.col("key") != fixed.MISSING, F.col("spelling"))
    return (
        spellings.withColumn("key", category_key(F.col("spelling")))
        .groupBy("dimension", "key")
        .agg(
            F.min_by(named, F.struct(named.isNull(), -F.col("rows"), named)).alias("label"),
            F.sum("rows").alias("rows"),
            *[F.sum(name).alias(name) for name in sums],
            F.count(named).alias("spellings"),
        )
        .select(
            "dimension", "key",
            F.when(F.col("key") == fixed.MISSING, F.lit(fixed.MISSING)).otherwise(F.col("label")).alias("segment"),
            "rows", *sums, "spellings",
        )
    )


def normalize_categorical(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The table with one column folded, and the report on it.

    Only categories written in more than one way need a lookup; every other row keeps its
    own trimmed text. The lookup is therefore small in practice, its size is known from its
    files, and the optimizer broadcasts it when it fits. When it does not, no category meets
    in one place: labels are repeated for each of `PARTS` parts that their rows are dealt
    into, and rows that are missing a value, which have no label, go by their own number.
    """
    spellings = materialize(spelling_counts(df, [column]), "spellings")
    labels = (
        fold(spellings)
        .filter((F.col("spellings") > 1) & (F.col("key") != fixed.MISSING))
        .select(F.col("key").alias("__key"), F.col("segment").alias("__label"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(PARTS)])).alias("__part"))
    )
    text, number = strip(as_text(df, column)), F.monotonically_increasing_id()
    keyed = df.withColumn("__key", category_key(text))
    keyed = keyed.withColumn("__part", F.when(F.col("__key") == fixed.MISSING, -1 - number).otherwise(F.pmod(number, F.lit(PARTS))))
    joined = keyed.join(materialize(labels, "labels"), ["__key", "__part"], "left")
    folded = F.when(F.col("__key") == fixed.MISSING, F.lit(fixed.MISSING)).otherwise(F.coalesce("__label", text))
    return joined.withColumn(column, folded).select(*[quoted(c) for c in df.columns]), report(spellings)


def report(spellings: DataFrame) -> DataFrame:
    """One row per dimension: spellings before, categories after, missing rows, merges."""
    missing = F.col("key") == fixed.MISSING
    raw = spellings.groupBy("dimension").agg(F.count("spelling").alias("raw_segments"))
    folded = fold(spellings).groupBy("dimension").agg(
        F.count("*").alias("normalized_segments"),
        F.count_if((F.col("spellings") > 1) & ~missing).alias("merged_segments"),
        F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("missing_rows"),
    )
    return raw.join(folded, "dimension")


def merged_spellings(spellings: DataFrame) -> DataFrame:
    """What was folded into what: `(dimension, segment, spelling, rows)`, one row per
    spelling that is not the label itself. Kept long, so it stays distributed."""
    labels = fold(spellings).filter((F.col("spellings") > 1) & (F.col("key") != fixed.MISSING))
    keyed = spellings.withColumn("key", category_key(F.col("spelling")))
    return (
        keyed.join(labels.select("dimension", "key", "segment"), ["dimension", "key"])
        .filter(F.col("spelling") != F.col("segment"))
        .select("dimension", "segment", "spelling", "rows")
    )


def normalization_report(df: DataFrame, column: str) -> DataFrame:
    """Summary of folding one column; `merged_spellings` lists the merges themselves.

    The merges stay a long table rather than one map per column, since their number grows
    with the data.
    """
    return report(materialize(spelling_counts(df, [column]), "spellings"))


def describe(spellings: DataFrame, shown_variants: int | None = None) -> list[str]:
    """Notes for people: one per dimension in which something was folded or missing.

    Three examples per dimension, chosen before anything reaches the driver, with all their
    variants or the `shown_variants` commonest; `merged_spellings` has every merge.
    """
    first_three = (
        fold(spellings)
        .filter((F.col("spellings") > 1) & (F.col("key") != fixed.MISSING))
        .withColumn("position", F.row_number().over(Window.partitionBy("dimension").orderBy("key")))
        .filter("position <= 3")
        .select("dimension", "key", "segment", "position", "spellings")
    )
    commonest = Window.partitionBy("dimension", "key").orderBy(F.desc("rows"), "spelling")
    variants = (
        spellings.withColumn("key", category_key(F.col("spelling")))
        .join(first_three, ["dimension", "key"])
        .filter(F.col("spelling") != F.col("segment"))
        .withColumn("place", F.row_number().over(commonest))
    )
    if shown_variants is not None:
        variants = variants.filter(F.col("place") <= shown_variants)
    listed: dict[tuple, list] = {}
    for row in variants.collect():
        listed.setdefault((row["dimension"], row["position"]), []).append(row)
    examples: dict[str, list[str]] = {}
    for (dimension, _), rows in sorted(listed.items()):
        rows.sort(key=lambda r: r["place"])
        hidden = rows[0]["spellings"] - 1 - len(rows)
        text = ", ".join(repr(r["spelling"]) for r in rows) + (f" and {hidden} more" if hidden else "")
        examples.setdefault(dimension, []).append(f"{rows[0]['segment']} <- {text}")
    notes = []
    for row in report(spellings).orderBy("dimension").collect():
        name, parts = row["dimension"], []
        if row["merged_segments"]:
            rest = row["merged_segments"] - 3
            parts.append(
                f"'{name}': {row['raw_segments']} spellings merged into {row['normalized_segments']} segments: "
                + "; ".join(examples[name]) + (f"; and {rest} more" if rest > 0 else "")
            )
        if row["missing_rows"]:
            parts.append(f"'{name}': {row['missing_rows']:,} rows without a value kept as segment {fixed.MISSING}")
        if parts:
            notes.append("; ".join(parts))
    return notes
