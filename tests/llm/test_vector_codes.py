import random

import numpy as np
import pytest

from deltascope.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string, d string"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds: every part against every entry."""
    kept = sorted(((i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], l) for i, v, l in rows if v and all(x is not None and np.isfinite(x) for x in v)))
    width = len(kept[0][1]) // parts
    book = [[list(v[a * width:a * width + width]) for _, v, _ in kept[:entries]] for a in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(v[a * width:a * width + width], e)), k) for k, e in enumerate(book[a])) for a in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assign()
        for a in range(parts):
            for k in range(len(book[a])):
                own = [v[a * width:a * width + width] for (_, v, _), f in zip(kept, found) if f[a][1] == k]
                if own:
                    book[a][k] = [sum(c) // len(own) for c in zip(*own)]
    codes = [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), l) for (i, _, l), f in zip(kept, assign())]
    totals = {}
    for _, _, e, l in codes:
        totals[l] = totals.get(l, 0) + e
    return sorted((i, c, e, totals[l]) for i, c, e, l in codes), book


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, l, "x", "y", "z") for i, v, l in rows], SCHEMA).repartition(3)
    found = vector_codes.compress(frame, **options)
    return sorted(tuple(r) for r in found.codes.select("vec_id", "code", "error", "label_error").collect()), found


def vectors(seed, n, length=16):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(length)], rng.choice([0, 1, None])) for i in range(n)]
    # repeated vectors, and grids full of ties
    return rows + [(n + i, [rng.choice([-0.5, 0.0, 0.5])] * length, 2) for i in range(n // 3)] + [(2 * n + i, rows[0][1], None) for i in range(n // 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_agree_with_plain_rounds(spark, seed):
    rows = vectors(seed, 90)
    rows += [(5000, None, 1), (5001, [None] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [float("inf")] * 16, 1), (5004, [], 1), (5005, [1.0] * 8, 1)]
    found, compressed = run(spark, rows)
    expected, book = brute([r for r in rows if r[0] != 5005])
    assert found == expected
    assert compressed.codebooks.tolist() == book
    assert len(compressed.digest()) == 64


def test_other_shapes_few_rows_and_empty_table(spark):
    rows = vectors(3, 4, length=6)[:5]
    found, compressed = run(spark, rows, parts=2, entries=3, rounds=2)
    assert found == brute(rows, 2, 3, 2)[0]
    few, compressed = run(spark, vectors(4, 3)[:2])
    assert few == brute(vectors(4, 3)[:2])[0] and compressed.codebooks.shape == (8, 2, 2)
    assert run(spark, [])[0] == []
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0] * 9, 0)])


def test_ids_that_are_shared_or_missing(spark):
    rows = [(None, [0.1] * 8, None), (7, [0.2] * 8, 1), (7, [0.2] * 8, 1), (3, [0.9] * 8, 1)]
    found, compressed = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), entries=2), None
    codes = [tuple(r) for r in found.codes.select("vec_id", "code").collect()]
    assert len(codes) == 4 and found.codebooks[0, 0].tolist() == [3686]


def test_balls_spare_most_comparisons_and_lose_none():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = (centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(np.int64)
    codes, _ = vector_codes.nearest(x, centres)
    moved = centres + rng.integers(-5, 6, centres.shape)
    radii = [int(np.sqrt(((x[codes == i] - moved[i]) ** 2).sum(1).max(initial=0))) + 1 for i in range(16)]
    best, least, compared = vector_codes.reassign(x, codes, moved, vector_codes.neighbours(moved, radii))
    plain, distances = vector_codes.nearest(x, moved)
    assert (best == plain).all() and (least == distances).all()
    assert compared < 0.05 * 15 * len(x)


def test_equal_entries_go_to_the_lower_index():
    book = np.array([[5], [1], [1], [3]])
    x = np.array([[1], [2], [4]])
    plain, _ = vector_codes.nearest(x, book)
    assert plain.tolist() == [1, 1, 0]
    for start in range(4):
        codes = np.full(3, start, np.uint8)
        radius = int(abs(x - book[start]).max())
        near = vector_codes.neighbours(book, [radius] * 4)
        assert vector_codes.reassign(x, codes, book, near)[0].tolist() == plain.tolist()
