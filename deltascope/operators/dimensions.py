"""Finding the columns worth breaking a change down by."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from deltascope.functions import fixed
from deltascope.functions.text import as_text, is_datetime, strip


def over_limit(df: DataFrame, values: dict[str, Column], limit: int) -> set[str]:
    """The names whose values are certainly more than `limit` different ones.

    Every task keeps a set of hashes per column until it has one too many; then the column is
    decided and no longer looked at. Sets of tasks are united, at most `limit` rows a column
    and task. Equal values have equal hashes, so a column over the limit by its hashes is over
    it by its values; the few that are not are for an exact count.
    """
    names = list(values)
    hashed = df.select(*[F.when(v.isNotNull(), F.xxhash64(v)).alias(f"h{i}") for i, v in enumerate(values.values())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set | None] = [set() for _ in names]
        for batch in batches:
            for i, own in enumerate(seen):
                if own is not None:
                    own.update(pc.unique(batch.column(i)).drop_null().to_pylist())
                    if len(own) > limit:
                        seen[i] = None
        rows = [(i, h) for i, own in enumerate(seen) for h in ([None] if own is None else own)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], pa.int32()), pa.array([h for _, h in rows], pa.int64())], names=["position", "hash"]
        )

    distinct = hashed.mapInArrow(run, "position int, hash bigint").distinct()
    found = distinct.groupBy("position").agg(F.count("*").alias("n"), F.bool_or(F.col("hash").isNull()).alias("over"))
    return {names[r["position"]] for r in found.collect() if r["over"] or r["n"] > limit}


def folded_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct values per column after trimming and lower-casing: `(dimension, distinct_values)`."""
    names = {c: f"d{i}" for i, c in enumerate(columns)}
    dimension = F.create_map(*[F.lit(x) for c in columns for x in (names[c], c)])
    return (
        df.select(*[F.lower(strip(as_text(df, c))).alias(names[c]) for c in columns])
        .unpivot([], list(names.values()), "dimension", "key")
        .filter(F.col("key").isNotNull())
        .distinct()
        .groupBy("dimension")
        .agg(F.count("*").alias("distinct_values"))
        .select(dimension[F.col("dimension")].alias("dimension"), "distinct_values")
    )


def auto_dimensions(
    df: DataFrame, exclude: set[str] = frozenset(), max_unique: int = fixed.AUTO_DIMENSION_MAX_DISTINCT
) -> list[str]:
    """Text columns with 2 to `max_unique` distinct values, spelling variants counted once.

    Columns of names or keys are ruled out by sets that stop at the limit; only the rest is
    counted exactly, and those are too few values to make a shuffle of any size.
    """
    text = [
        f.name for f in df.schema.fields
        if f.name not in exclude and not isinstance(f.dataType, (T.NumericType, T.BooleanType)) and not is_datetime(f.dataType)
    ]
    if not text:
        return []
    many = over_limit(df, {c: F.lower(strip(as_text(df, c))) for c in text}, max_unique)
    few = [c for c in text if c not in many]
    if not few:
        return []
    counts = {r["dimension"]: r["distinct_values"] for r in folded_counts(df, few).collect()}
    return [c for c in few if 2 <= counts.get(c, 0) <= max_unique]
