"""Product quantisation of vectors by ball k-means, in whole numbers.

Vectors are cut into equal parts; each part position has a codebook, trained by rounds of
exact assignment and integer means. A codebook entry and the parts that it has make a ball.
From the radii of the balls and the distances between entries follows, once a round and
from a table of `parts` x `entries` rows alone, which entries are neighbours at all: entry
j can take parts from entry i only if |ij| <= 2 r_i. Inside a task, a part at distance d
from its entry is compared with the neighbours at |ij| <= 2 d and no others: nearer than
half the way to the first neighbour lies the stable core, which needs no comparison, and
beyond it each annular ring has one candidate more. All bounds are compared as whole
numbers, so that ties are never pruned.

Every round reads the written table of the one before and sends one row for each part and
entry of a partition to the aggregation: a vector that a third of the rows have is summed
where it is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from deltascope.llm.common import materialize, release

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6


@dataclass(frozen=True)
class Compressed:
    """`codes` has vec_id, label, code, error and label_error; `codebooks[part][entry]` are whole numbers."""

    codes: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


# --- one batch of parts


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of every row of `x`; ties go to the lower index."""
    best = np.zeros(len(x), np.uint8)
    least = ((x - codebook[0]) ** 2).sum(1)
    for j in range(1, len(codebook)):
        distance = ((x - codebook[j]) ** 2).sum(1)
        closer = distance < least
        best[closer], least[closer] = j, distance[closer]
    return best, least


def reassign(x: np.ndarray, codes: np.ndarray, codebook: np.ndarray, near: list) -> tuple[np.ndarray, np.ndarray, int]:
    """`nearest`, starting from an earlier assignment and the neighbours of every entry.

    Also returns how many distances to other entries were computed.
    """
    least = ((x - codebook[codes]) ** 2).sum(1)
    best, compared = codes.copy(), 0
    order = np.argsort(codes, kind="stable")
    for i, members in zip(*_groups(codes[order], order)):
        others, apart = near[i]
        # how many neighbours the ring of each part reaches; none in the stable core
        reach = np.searchsorted(apart, 4 * least[members], side="right")
        for rank in range(int(reach.max(initial=0))):
            j, ring = others[rank], members[reach > rank]
            distance = ((x[ring] - codebook[j]) ** 2).sum(1)
            compared += len(ring)
            closer = (distance < least[ring]) | ((distance == least[ring]) & (j < best[ring]))
            ring = ring[closer]
            best[ring], least[ring] = j, distance[closer]
    return best, least, compared


def _groups(sorted_codes: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(sorted_codes)) + 1
    members = np.split(order, cuts) if len(order) else []
    return [int(sorted_codes[c]) for c in [0, *cuts]] if len(order) else [], members


def neighbours(codebook: np.ndarray, radii: list[int]) -> list:
    """For each entry, the entries within twice its radius, nearest first, and their squared distances."""
    found = []
    for i, radius in enumerate(radii):
        apart = ((codebook - codebook[i]) ** 2).sum(1)
        near = [j for j in range(len(codebook)) if j != i and int(apart[j]) <= 4 * radius * radius]
        near.sort(key=lambda j: (apart[j], j))
        found.append((np.array(near, np.int64), apart[near]))
    return found


def _up(square: int) -> int:
    """The root of a square, rounded up."""
    root = isqrt(square)
    return root + (root * root < square)


# --- passes over the table


def _vectors(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, -1)


def _assign(state: DataFrame, codebooks: np.ndarray, near: list | None) -> DataFrame:
    """Every row with its new codes and squared distances, written."""
    parts = len(codebooks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, parts)
            if near is not None:
                before = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            codes, distances = np.empty((len(x), parts), np.uint8), np.empty((len(x), parts), np.int64)
            for a in range(parts):
                if near is None:
                    codes[:, a], distances[:, a] = nearest(x[:, a], codebooks[a])
                else:
                    codes[:, a], distances[:, a], _ = reassign(x[:, a], before[:, a], codebooks[a], near[a])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("label"), batch.column("v"),
                    pa.array([row.tobytes() for row in codes], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, distances.size + 1, parts, dtype=np.int32), distances.ravel()),
                ],
                names=["vec_id", "label", "v", "codes", "d"],
            )

    schema = StructType([
        *[state.schema[name] for name in ("vec_id", "label", "v")],
        StructField("codes", BinaryType()), StructField("d", ArrayType(LongType())),
    ])
    return materialize(state.mapInArrow(run, schema), "vector-codes")


def _balls(state: DataFrame, parts: int, entries: int, width: int) -> list:
    """Rows (part, entry, n, squared radius, sums of components) of the entries in use, at most `parts` x `entries`."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), np.int64)
        counts, radii = np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _vectors(batch, parts)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            distances = batch.column("d").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            for a in range(parts):
                np.add.at(sums[a], codes[:, a], x[:, a])
                np.add.at(counts[a], codes[:, a], 1)
                np.maximum.at(radii[a], codes[:, a], distances[:, a])
        used = [(a, e) for a in range(parts) for e in range(entries) if counts[a, e]]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([a for a, _ in used], pa.int32()), "entry": pa.array([e for _, e in used], pa.int32()),
            "n": pa.array([int(counts[u]) for u in used], pa.int64()), "radius": pa.array([int(radii[u]) for u in used], pa.int64()),
            "sums": pa.array([sums[u].tolist() for u in used], pa.list_(pa.int64())),
        })

    partial = state.select("v", "codes", "d").mapInArrow(run, "part int, entry int, n long, radius long, sums array<long>")
    added = F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums")
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), added).collect()


def _moved(codebooks: np.ndarray, balls: list) -> tuple[np.ndarray, list]:
    """The means of all entries, and the neighbours that their balls leave."""
    after = codebooks.copy()
    radii = [[0] * codebooks.shape[1] for _ in codebooks]
    for row in balls:
        after[row.part, row.entry] = [s // row.n for s in row.sums]
        shift = int(((after[row.part, row.entry] - codebooks[row.part, row.entry]) ** 2).sum())
        # around its new place, a ball reaches no further than its radius and its shift together
        radii[row.part][row.entry] = _up(row.radius) + _up(shift)
    return after, [neighbours(after[a], radii[a]) for a in range(len(after))]


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Compressed:
    """Codes of all usable vectors, and the codebooks they were trained to.

    Each component x becomes floor(scale * x). A codebook starts from the vectors of the
    `entries` smallest ids; `rounds` times all parts are assigned to the nearest entry and
    entries become floored means; then all are assigned once more. An entry that has no
    part stays. The frame has `vec_id`, `label`, `code` (two hex digits a part), `error`
    (squared distances to the entries, added up) and `label_error` (errors of all rows of
    one label; rows without a label together).

    A vector is dropped if it is null or empty, holds a null, NaN or infinite component, or
    has another length than that of the smallest id. Null ids come last; rows that share an
    id are rows of their own, ordered by their components. Equally near entries: the lower
    index. With fewer rows than `entries`, codebooks have that many entries. An empty table
    gives no rows and empty codebooks. Extra columns are left out. Lengths that `parts`
    does not divide, and components whose squares could exceed 64 bits, end in an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("A code has two hex digits: between 1 and 256 entries.")
    rows = vectors.select(
        F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{label_column}`").alias("label"), F.col(f"`{vector_column}`").alias("x")
    ).where(_usable(F.col("x")))
    by_id = F.col("vec_id").asc_nulls_last()
    shortest = rows.select("vec_id", F.size("x").alias("n")).orderBy(by_id, "n").limit(1).collect()
    length = shortest[0].n if shortest else parts
    if length % parts:
        raise ValueError(f"Vectors of {length} components can't be cut into {parts} equal parts.")
    width = length // parts
    limit = isqrt(2**60 // width) // 2
    whole = F.transform("x", lambda x: F.floor(F.when(
        F.abs(x.cast("double")) * scale < limit, x.cast("double") * scale
    ).otherwise(F.raise_error(F.lit(f"A component times {scale} reaches {limit}: its squares may exceed 64 bits.")))).cast("int"))
    state = materialize(rows.where(F.size("x") == length).select("vec_id", "label", whole.alias("v")), "vector-parts")
    seeds = state.orderBy(by_id, "v").select("v").limit(entries).collect()
    codebooks = np.array([row.v for row in seeds], np.int64).reshape(len(seeds), parts, width).swapaxes(0, 1).copy()
    if not seeds:
        empty = state.select("vec_id", "label", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")])
        return Compressed(empty, codebooks)

    near = None
    for turn in range(rounds + 1):
        before, state = state, _assign(state, codebooks, near)
        release(before)
        if turn < rounds:
            codebooks, near = _moved(codebooks, _balls(state, parts, len(seeds), width))
    error = F.aggregate("d", F.lit(0).cast("long"), lambda t, x: t + x)
    coded = state.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), error.alias("error"))
    # written, so that its size decides whether it is broadcast
    totals = materialize(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return Compressed(coded.join(totals, coded["label"].eqNullSafe(totals["_label"])).drop("_label"), codebooks)
