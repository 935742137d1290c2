import random
import re
from collections import Counter

import numpy as np
import pytest

from deltascope.llm import ranked_search
from deltascope.llm.ranked_search import Node, Query, Rows, weight

TERM = "[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(TERM, "".join(c.lower() if c.isascii() else c for c in text)) if text else []


def brute(docs, items, top=20):
    """Every document against every item."""
    counts = [(i, Counter(words(t))) for i, t in docs if words(t)]
    documents, length = len(counts), sum(sum(c.values()) for _, c in counts)
    frequency = Counter(t for _, c in counts for t in c)
    found = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * documents // length
            score = sum(weight(documents, frequency[t]) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0 and i is not None:
                scored.append((-score, i))
        found += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(found, key=repr)


def run(spark, docs, items, **options):
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id long, text string, score string, term string").repartition(3)
    items = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(map(tuple, ranked_search.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "ß", "日本", "A1"]
    text = lambda k: " ".join(rng.choice(vocabulary[: rng.randint(1, 64)]) + rng.choice([",", "", ".", "-x"]) for _ in range(k))
    docs = [(i, text(rng.randint(1, 60))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(n // 4)]  # a large group of copies: ties
    docs += [(9000, None), (9001, ""), (9002, "... !"), (9003, "w1 " * 5000), (None, "w1 w2 w3"), (5, docs[5][1])]
    rng.shuffle(docs)
    items = [(i, text(rng.randint(1, 30))) for i in range(8)] + [(50, None), (51, "?"), (52, "unseen words"), (53, docs[3][1]), (None, "w1 W2"), (0, "ß ß Ünï")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_brute_force(spark, seed, monkeypatch):
    docs, items = corpus(seed, 300)
    monkeypatch.setattr(ranked_search, "BLOCK", 100)
    assert run(spark, docs, items) == brute(docs, items)


def test_queries_in_several_blocks_and_other_limits(spark, monkeypatch):
    docs, items = corpus(3, 60)
    monkeypatch.setattr(ranked_search, "MOST_TERMS", 12)
    assert run(spark, docs, items, top=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(4, 5)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == []
    assert run(spark, [(1, None)], items) == []


def test_tree_is_exact_and_spares_leaves():
    """Documents about few subjects: most leaves are never scored, and none that matters is missed."""
    rng = np.random.default_rng(6)
    width, n = 400, 3000
    subject = rng.integers(0, 20, n)
    columns = [np.unique(rng.choice(np.arange(s * 20, s * 20 + 20), 14)) for s in subject]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])])
    columns = np.concatenate(columns)
    rows = Rows(np.arange(n), starts, columns, rng.integers(400_000, 900_000, len(columns)), width)
    root = Node(rows)
    leaves, total = sum(1 for node, _ in nodes(root) if not node.children), 0
    for s in range(20):
        asked = np.arange(s * 20, s * 20 + 15)
        query = Query(asked, rng.integers(2_000, 9_000, len(asked)), width, 20)
        scored = query.search(root)
        dense = np.zeros(width, np.int64)
        dense[asked] = query.weights
        scores = rows.dot(dense)
        assert sorted(query.best, reverse=True) == sorted(((int(x), -i) for i, x in enumerate(scores)), reverse=True)[:20]
        total += scored
        assert all(query.bound(node) >= max(scores[list(ids)]) for node, ids in nodes(root))
    assert total < 0.5 * 20 * leaves


def nodes(node):
    """Every node with the ids below it."""
    if not node.children:
        yield node, node.rows.ids
        return
    below = []
    for child in node.children:
        for found, ids in nodes(child):
            yield found, ids
            if not found.children:
                below.extend(ids)
    yield node, np.array(below)
