"""Exact ranked lexical search with ball trees over sparse document vectors.

A document's coordinate on a term is its saturated term frequency, a whole number that
depends on the term's occurrences and the document's length alone; a query's is the weight
of the term times its occurrences in the query. The score is their inner product.

Documents are read in blocks. In each, a ball tree halves the vectors between two far
points until leaves are small; every node has a centre of whole numbers, the exact square
of its radius and the set of terms that occur below it. In the space of those terms lies
the whole ball, so no document below a node can score more than `q.c + |q| r`, rounded up,
with `q` cut to those terms. A search that opens nodes best-first may stop at the first one
that can't reach the worst of the best `k` found so far. Leaves are scored exactly, in whole numbers. The best
`k` of a task carry over from block to block and prune the later ones.

Only query terms matter to a score, so a document's vector has no others; the statistics
(number of documents, lengths, document frequencies) are of all documents. Queries are
taken in blocks of limited size, each against all documents.
"""

from __future__ import annotations

import heapq
import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from deltascope.llm.common import materialize

TOP = 20
LEAF = 32
BLOCK = 4096  # documents in one tree
MOST_TERMS = 20_000  # distinct terms of one block of queries, unless a single query has more
MOST_QUERIES = 500

# fixed values of the score: saturation 1.2, length normalisation 0.25, in thousandths and hundredths
UNIT, SATURATION, SLOPE = 1_000_000_000, 12, 25

_KEPT = set(string.ascii_letters + string.digits)
_TABLE = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b) in _KEPT else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and any other characters beyond ASCII; A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


# --- a tree over the rows of a sparse matrix


class Rows:
    """Sparse vectors of whole numbers: row i has `values` at `columns` from starts[i] to starts[i + 1], never none."""

    def __init__(self, ids, starts, columns, values, width):
        self.ids, self.starts, self.columns, self.values, self.width = ids, starts, columns, values, width
        self.squares = np.add.reduceat(values * values, starts[:-1])

    def take(self, rows: np.ndarray) -> Rows:
        lengths = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(starts[-1]) + np.repeat(self.starts[rows] - starts[:-1], lengths)
        return Rows(self.ids[rows], starts, self.columns[places], self.values[places], self.width)

    def dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width, np.int64)
        part = slice(self.starts[row], self.starts[row + 1])
        out[self.columns[part]] = self.values[part]
        return out

    def dot(self, vector: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * vector[self.columns], self.starts[:-1])

    def apart(self, vector: np.ndarray) -> np.ndarray:
        """Squared distances, exact."""
        return self.squares - 2 * self.dot(vector) + int((vector * vector).sum())

    def mean(self) -> np.ndarray:
        total = np.bincount(self.columns, self.values, self.width)
        return np.rint(total / len(self.ids)).astype(np.int64)


class Node:
    __slots__ = ("centre", "radius", "occurring", "first_id", "rows", "children")

    def __init__(self, rows: Rows, leaf: int = LEAF):
        # any centre gives valid bounds; whole numbers make them exact
        self.centre = rows.mean()
        distances = rows.apart(self.centre)
        self.radius = int(distances.max())
        self.occurring = np.zeros(rows.width, bool)
        self.occurring[rows.columns] = True
        self.first_id = int(rows.ids.min())
        self.rows, self.children = rows, ()
        if len(rows.ids) > leaf and self.radius > 0:
            one = rows.dense(int(distances.argmax()))
            from_one = rows.apart(one)
            other = rows.dense(int(from_one.argmax()))
            # nearer to one than to the other; halves, so that depth stays logarithmic
            order = np.argsort(from_one - rows.apart(other), kind="stable")
            half = len(order) // 2
            self.rows, self.children = None, tuple(Node(rows.take(part), leaf) for part in (order[:half], order[half:]))


class Query:
    """Its terms as columns, their weights times occurrences, and the best found so far."""

    def __init__(self, columns: np.ndarray, weights: np.ndarray, width: int, top: int):
        self.columns, self.weights, self.width, self.top = columns, weights, width, top
        self.squares = weights.astype(float) ** 2
        self.best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first

    def bound(self, node: Node) -> int:
        """No document below the node scores more: roots and their product rounded up."""
        exact = int((node.centre[self.columns] * self.weights).sum())
        if node.radius == 0:
            return exact
        # far more than the rounding of two roots, a sum and a product
        length = math.sqrt(self.squares[node.occurring[self.columns]].sum())
        return exact + math.ceil(length * math.sqrt(node.radius) * (1 + 1e-9)) + 1

    def hopeless(self, bound: int, first_id: int) -> bool:
        """Neither the score nor, at equal score, the smallest id can enter the best."""
        return bound <= 0 or len(self.best) == self.top and (bound, -first_id) < self.best[0]

    def search(self, root: Node) -> int:
        """Open nodes best-first; how many leaves were scored."""
        scored, count = 0, 0
        dense = np.zeros(self.width, np.int64)
        dense[self.columns] = self.weights
        queue = [(-self.bound(root), count, root)]
        while queue:
            bound, _, node = heapq.heappop(queue)
            if self.hopeless(-bound, node.first_id):
                if -bound <= 0 or -bound < self.best[0][0]:
                    break  # all that wait have bounds as low
                continue
            if not node.children:
                scored += 1
                self._score(node.rows, dense)
            for child in node.children:
                bound = self.bound(child)
                if not self.hopeless(bound, child.first_id):
                    count += 1
                    heapq.heappush(queue, (-bound, count, child))
        return scored

    def _score(self, rows: Rows, dense: np.ndarray) -> None:
        scores = rows.dot(dense)
        least = self.best[0][0] if len(self.best) == self.top else 1
        for i in np.flatnonzero(scores >= max(least, 1)):
            found = (int(scores[i]), -int(rows.ids[i]))
            if len(self.best) < self.top:
                heapq.heappush(self.best, found)
            elif found > self.best[0]:
                heapq.heapreplace(self.best, found)


# --- passes over the documents


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf): the length of every document and its occurrences of query terms, written."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, starts, found, occurrences = [], [0], [], []
            for text in batch.column("text"):
                words = terms(text.as_py())
                lengths.append(len(words))
                counts = Counter(map(vocabulary.get, words))
                counts.pop(None, None)
                found.extend(counts.keys())
                occurrences.extend(counts.values())
                starts.append(len(found))
            offsets = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(occurrences, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tf"],
            )

    return materialize(docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>"), "term-counts")


def _best(counted: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], width: int, documents: int, length: int, top: int) -> DataFrame:
    """(query, task, doc_id, score): the best of every task, at most `top` a query."""
    def vectors(table: pa.Table) -> Rows:
        columns = table.column("terms").combine_chunks()
        sizes = columns.value_lengths().to_numpy()
        n = np.repeat(table.column("n").to_numpy(), sizes)
        tf = table.column("tf").combine_chunks().flatten().to_numpy()
        m = 100 - SLOPE + (SLOPE * n * documents) // length
        return Rows(
            table.column("doc_id").to_numpy(), np.concatenate([[0], np.cumsum(sizes)]),
            columns.flatten().to_numpy().astype(np.int64), (UNIT * tf) // (1000 * tf + SATURATION * m), width,
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        searches = [(number, Query(columns, weights, width, top)) for number, columns, weights in queries]
        for table in _blocks(batches, BLOCK):
            root = Node(vectors(table))
            for _, search in searches:
                search.search(root)
        found = [(number, -negative, score) for number, search in searches for score, negative in search.best]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({
            "query": pa.array([f[0] for f in found], pa.int64()), "task": pa.array([task] * len(found), pa.int64()),
            "doc_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.int64()),
        })

    return counted.where(F.size("terms") > 0).mapInArrow(run, "query long, task long, doc_id long, score long")


def _blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows in tables of `rows` each."""
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _top(found: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy("query", *keys).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _query_blocks(items: Iterable) -> Iterator[tuple[list, dict[bytes, int]]]:
    """Queries with their term counts, and the terms of all of them, block by block."""
    block, vocabulary = [], {}
    for row in items:
        counts = Counter(terms(row.text))
        new = [t for t in counts if t not in vocabulary]
        if block and (len(vocabulary) + len(new) > MOST_TERMS or len(block) == MOST_QUERIES):
            if vocabulary:
                yield block, vocabulary
            block, vocabulary, new = [], {}, list(counts)
        for term in new:
            vocabulary[term] = len(vocabulary)
        block.append((row.item_id, counts))
    if vocabulary:
        yield block, vocabulary


def search(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", top: int = TOP,
) -> DataFrame:
    """The `top` best documents of every item: its id, `rank` from 1, the document's id and its `score`.

    Scores are whole numbers above 0; at equal score the smaller document id ranks first.
    Documents with a null text, or without a term, are in no result and not counted.
    Document ids are whole numbers; a document without one can't be named and is left out
    of the ranks, though it counts in the statistics. Documents that share an id are ranked
    each by itself. Every row of `items` is an item, also where ids repeat or are null; an
    item without terms finds nothing. Very long texts are read whole. Extra columns are
    left out. Empty tables give no rows.

    Items are read by the driver one partition at a time and searched in blocks, so many
    are possible, at the price of one pass over the documents a block.
    """
    if top < 1:
        raise ValueError("At least one document is asked for.")
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    asked = items.select(F.col(f"`{item_column}`").alias("item_id"), F.col(f"`{item_text_column}`").alias("text"))
    results = []
    for block, vocabulary in _query_blocks(asked.toLocalIterator()):
        counted = _counted(texts, vocabulary)
        documents, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not length:
            continue
        # at most as many rows as the block of queries has terms
        frequencies = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = {row["term"]: weight(documents, row["count"]) for row in frequencies}
        queries = []
        for number, (_, counts) in enumerate(block):
            known = {vocabulary[t]: n * weights[vocabulary[t]] for t, n in counts.items() if weights.get(vocabulary[t])}
            if known:
                queries.append((number, np.array(list(known), np.int64), np.array(list(known.values()), np.int64)))
        if not queries:
            continue
        found = materialize(_best(counted.where(F.col("doc_id").isNotNull()), queries, len(vocabulary), documents, length, top), "search-best")
        # tasks are merged in groups, so that no merge reads from all of them
        groups = math.isqrt(found.agg(F.coalesce(F.max("task"), F.lit(0))).first()[0]) + 1
        found = _top(found.withColumn("group", F.col("task") % groups), top, "group").drop("rank")
        names = spark.createDataFrame(
            [(number, item) for number, (item, _) in enumerate(block)], StructType([StructField("query", LongType()), asked.schema["item_id"]])
        )
        ranked = _top(found, top).join(F.broadcast(names), "query")  # at most MOST_QUERIES rows
        results.append(ranked.select("item_id", "rank", "doc_id", "score"))
    if not results:
        return asked.select("item_id").limit(0).selectExpr("item_id", "0 AS rank", "cast(0 AS bigint) AS doc_id", "cast(0 AS bigint) AS score")
    # each block is written before the next is planned upon it
    whole = results[0]
    for part in results[1:]:
        whole = whole.unionByName(part)
    return whole
