import random
from itertools import combinations

import numpy as np
import pytest

from deltascope.llm import jaccard


def sets_of(rows, words):
    out = {}
    for i, text in rows:
        own = (text or "").encode().lower().split()
        out[i] = {tuple(own[k:k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else {tuple(own)} if own else set()
    return out


def brute(rows, words, percent):
    sets = sets_of(rows, words)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(words))
                words[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 9, 12, 20, 30, 60, 150, 300]))]
        rows.append((i, " ".join(words) or "w"))
    return rows


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_components_agree_with_brute_force(make, words, percent):
    rows = corpus(words, 260) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "One\ttwo")]
    rng = random.Random(1)
    base = [f"v{i}" for i in range(120)]
    for i in range(60):  # a large group of near copies, many of which are not linked to each other
        own = list(base)
        for _ in range(2):
            own[rng.randrange(120)] = f"x{rng.randrange(50)}"
        rows.append((1000 + i, " ".join(own)))
    rows.append((2000, " ".join(f"long{i}" for i in range(20000))))
    rows.append((2001, " ".join(f"long{i}" for i in range(19999))))
    got = jaccard.near_duplicates(make(rows, extra=True), words, percent).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute(rows, words, percent)
    assert len(got) == len(rows)


def test_repeated_rows_missing_ids_and_empty_tables(make):
    text = " ".join(f"w{i}" for i in range(50))
    rows = jaccard.near_duplicates(make([(3, text), (3, text), (5, text), (None, text), (7, None)])).collect()
    assert sorted((str(r[0]), str(r[2])) for r in rows) == [("3", "3"), ("3", "3"), ("5", "3"), ("7", "7"), ("None", "None")]
    assert jaccard.near_duplicates(make([])).count() == 0
    docs = make([(3, text), (5, text), (None, text), (7, "else")], extra=True)
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "7", "None"]


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("documents", [1e3, 1e7])
def test_linked_sets_always_share_a_signature(percent, documents):
    """Pigeonhole and sketches, for allocations of small and large corpora."""
    bands = tuple(jaccard.allocate(low, high, percent, documents) for low, high in jaccard.band_limits(percent))
    rng = np.random.default_rng(3)
    for size in [*range(1, 40), 60, 100, 250, 700]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**63, size, dtype="u8"))
            b = a
            while True:  # as far apart as links go
                c = np.unique(np.concatenate([b[rng.permutation(len(b))[:len(b) - rng.integers(0, 2)]], rng.integers(0, 2**63, rng.integers(0, 2), dtype="u8")]))
                both = len(np.intersect1d(a, c))
                if not len(c) or 100 * both < percent * (len(a) + len(c) - both):
                    break
                b = c
                if rng.random() < 0.02:
                    break
            assert len(np.intersect1d(jaccard.signatures(a, bands, percent), jaccard.signatures(b, bands, percent))), size


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "a long, b long")
    found = {r["node"]: r["component"] for r in jaccard.components(links).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {201: 200}


def test_allocation_grows_with_collisions():
    few, many = (jaccard.allocate(10, 11, 90, n) for n in (1e3, 1e9))
    assert few.exact + 2 * few.deletion >= 2 and many.exact + 2 * many.deletion >= 2
    assert many.deletion >= few.deletion


def test_unlinked_group_passes_on_few_pairs(make, monkeypatch):
    """Hundreds of texts that share signatures and most shingles without being linked: hardly a pair of them moves its sets."""
    rng = random.Random(7)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(240):
        own = common.copy()
        for at in rng.sample(range(0, 120, 4), 9):  # each change touches three shingles of its own
            own[at] = f"u{i}x{at}"
        rows.append((i, " ".join(own)))
    passed, whole = [], jaccard.materialize

    def counting(df, label="table"):
        table = whole(df, label)
        if label == "pairs":
            passed.append(table.count())
        return table

    monkeypatch.setattr(jaccard, "materialize", counting)
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(make(rows), 3, 90).collect()}
    assert found == {i: c for i, (_, c) in brute(rows, 3, 90).items()} and len(set(found.values())) > 200
    assert sum(passed) < 240 * 239 / 2 / 20


def test_no_table_is_broadcast_through_the_driver(spark):
    # small tables would be collected by the driver for a broadcast join, and its memory grows run by run
    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3} common text here") for i in range(60)] + [(60, None), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.near_duplicates(docs, 3, 90)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.component_id for r in found.collect() if r.doc_id is not None} == {i: c for i, (_, c) in brute(rows[:61], 3, 90).items()}


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("documents", [1e3, 1e7])
def test_linked_sets_share_a_signature_that_neither_leaves_out(percent, documents):
    """Whatever the order by which the commonest go, also where just the shared ones come first."""
    bands = tuple(jaccard.allocate(low, high, percent, documents) for low, high in jaccard.band_limits(percent))
    rng = np.random.default_rng(4)
    left_out = 0

    def band(x):
        return int(x) >> jaccard.REST & (2**jaccard.BAND_BITS - 1)

    for size in [*range(1, 40), 60, 100, 250, 700, 1500]:
        a = np.unique(rng.integers(0, 2**63, size, dtype="u8"))
        n = size
        while n and 100 * (n - 1) >= percent * size:
            n -= 1
        b = np.unique(np.concatenate([a[rng.permutation(size)[:n]], rng.integers(0, 2**63, (100 * n - percent * size) // percent, dtype="u8")]))
        both = len(np.intersect1d(a, b))
        assert 100 * both >= percent * (len(a) + len(b) - both)
        found = [jaccard.signed_set(x, bands, percent) for x in (a, b)]
        shared = {*found[0][0].tolist()} & {*found[1][0].tolist()}
        for salt in range(4):  # 0: what both have goes first
            rest = []
            for own, spare in found:
                order = sorted(own.tolist(), key=lambda x: (salt == 0 and x not in shared, hash((x, salt))))
                for y in spare.tolist():
                    first = [x for x in order if band(x) == band(y)][:y >> jaccard.REST + jaccard.BAND_BITS]
                    left_out += len(first)
                    order = [x for x in order if x not in first]
                rest.append({*order})
            assert rest[0] & rest[1], (size, salt)
    assert left_out > 50


def test_unlinked_large_sets_hardly_share_a_signature():
    """Empty segments of large sets agreed by chance: the pairs to compare grew with the square of their number."""
    bands = tuple(jaccard.allocate(low, high, 80, 5000) for low, high in jaccard.band_limits(80))
    rng = np.random.default_rng(5)
    found = [jaccard.signatures(rng.integers(0, 2**63, size, dtype="u8"), bands, 80) for size in rng.integers(800, 1300, 200)]
    met = np.unique(np.concatenate(found), return_counts=True)[1]
    assert (met * (met - 1) // 2).sum() < 200


def test_a_passage_of_all_documents_makes_few_pairs(make, monkeypatch):
    """Segments that hold nothing but shingles of a common passage are left out."""
    rng = random.Random(9)
    passage = [f"c{i}" for i in range(24)]
    rows = [(i, " ".join(passage + [f"u{i}x{k}" for k in range(rng.randint(90, 110))])) for i in range(400)]
    rows += [(i + 1000, text.replace(" c3 ", " d3 ")) for i, text in rows[:5]]
    members, whole = [], jaccard.materialize

    def keeping(df, label="table"):
        table = whole(df, label)
        if label == "members":
            members.append({r.signature: r["count"] for r in table.groupBy("signature").count().collect()})
        return table

    monkeypatch.setattr(jaccard, "materialize", keeping)
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(make(rows), 5, 80).collect()}
    assert found == {i: i % 1000 for i, _ in rows}
    assert sum(n * (n - 1) // 2 for n in members[0].values()) < 1000  # 24,000 where all signatures stay
