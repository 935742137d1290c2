"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

1. Each document becomes token ids in Arrow batches; longer ones are cut into pieces.
2. Pieces are counted by length. That table has at most `capacity` rows whatever the size
   of the corpus, so the packing itself is planned on it: equal lengths are interchangeable.
3. Bin completion plans the sequences: around the largest piece left, the undominated
   fillings of the remaining room are enumerated; branches are cut when the room they waste
   exceeds what the bound on the number of sequences still allows. The best-fit decreasing
   plan is the first incumbent. A plan is a list of fillings, each with how many sequences
   repeat it, so it stays as small as the table of lengths.
4. Pieces of one length are numbered by (length, salt) groups, offset by the counts of the
   groups before. The number says which filling, which repetition and which place is theirs.

No step brings more than the counts to the driver, and a length that a third of all pieces
share is numbered in as many groups as there are salts.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from deltascope.llm.common import materialize, pruned

CAPACITY = 2048
END = 0  # id that ends every document
SALTS = 64  # groups in which pieces of one length are numbered
SEARCH_STEPS = 200_000  # nodes the search for better plans may visit, over the whole plan

# fixed value: how byte-level BPE of this family splits a text
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_RUN = 2000  # characters

# --- tokens


class Encoder:
    """Ids of a byte-level BPE tokenizer file of the tokenizers library.

    The file's vocabulary, run by tiktoken, gives the same ids several times faster. The
    first text of every batch is encoded by both, and any difference is an error. Texts with
    very long words or white space, which tiktoken takes badly, go to tokenizers alone.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in self.tokenizer.get_vocab().items() if token not in special}
        self.fast = tiktoken.Encoding("from_file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def by_tokenizers(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, one after the other."""
        words = list(map(len, text.split()))
        blanks = len(text) - sum(words) - len(words)  # beyond one after each word
        if blanks > LONG_RUN or max(words, default=0) > LONG_RUN:
            return self.by_tokenizers(text)
        return np.array(self.fast.encode_to_numpy(text), dtype="<u4").tobytes()

    def check(self, text: str) -> None:
        if self(text) != self.by_tokenizers(text):
            raise ValueError("the two encoders disagree; this tokenizer file is not a byte-level BPE of the expected kind")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which takes what is left over."""
    first = n % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece, and its ids if asked for."""
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer), np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            if len(batch):
                encode.check(batch["text"].iloc[0])
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start:4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), *[own] * with_ids))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")]).astype({"doc_id": "Int64"})

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInPandas(run, fields)


# --- plan: fillings and how often each is repeated


Filling = tuple[int, ...]  # lengths, largest first


def sequences_needed(counts: dict[int, int], capacity: int) -> int:
    """Lower bound on the number of sequences: pieces over half can't meet, small ones fill the rest."""
    total = -(-sum(length * n for length, n in counts.items()) // capacity)
    return max(total, sum(n for length, n in counts.items() if 2 * length > capacity))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts: equal pieces that find equal room are placed at once."""
    room: dict[int, Counter] = {}  # room left -> fillings with that room
    open_rooms: list[int] = []  # the keys of `room`, ascending
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = np.searchsorted(open_rooms, length)
            if at == len(open_rooms):  # new sequences, each with as many of these as fit
                each = capacity // length
                made, rest = divmod(left, each)
                new = Counter({(length,) * each: made} if made else {})
                if rest:
                    new[(length,) * rest] += 1
                left = 0
            else:
                gap = open_rooms[at]
                filling, n = next(iter(room[gap].items()))
                each = min(gap // length, left)
                n = min(n, left // each)
                room[gap][filling] -= n
                if not room[gap][filling]:
                    del room[gap][filling]
                if not room[gap]:
                    del room[gap], open_rooms[at]
                new = Counter({filling + (length,) * each: n})
                left -= n * each
            for filling, n in new.items():
                gap = capacity - sum(filling)
                if gap not in room:
                    room[gap] = Counter()
                    open_rooms.insert(bisect_right(open_rooms, gap), gap)
                room[gap][filling] += n
    return [(f, n) for fillings in room.values() for f, n in fillings.items()]


def undominated(room: int, lengths: list[int], counts: Counter, most_waste: int, steps: list[int]) -> Iterator[Filling]:
    """Fillings of `room`, largest piece first, to which no further piece can be added.

    A filling is dominated if one of its pieces can be swapped for a larger one that is
    left over and still fits; such fillings are skipped, as are those that leave more than
    `most_waste`. `lengths` are in descending order; every visited node counts into `steps`.
    """
    def extend(at: int, gap: int, chosen: tuple[int, ...]) -> Iterator[Filling]:
        steps[0] -= 1
        smallest = lengths[-1]
        if gap < smallest or steps[0] <= 0:
            if gap <= most_waste and not swappable(chosen, gap):
                yield chosen
            return
        fitted = False
        for k in range(at, len(lengths)):
            length = lengths[k]
            if length > gap or counts[length] <= chosen.count(length):
                continue
            fitted = True
            yield from extend(k, gap - length, chosen + (length,))
            if steps[0] <= 0:
                return
        if not fitted and gap <= most_waste and not any(
            x <= gap and counts[x] > chosen.count(x) for x in lengths
        ) and not swappable(chosen, gap):
            yield chosen

    def swappable(chosen: Filling, gap: int) -> bool:
        return any(counts[y] > chosen.count(y) for x in set(chosen) for y in range(x + 1, x + gap + 1) if y in counts)

    yield from extend(0, room, ())


def complete_bins(counts: dict[int, int], capacity: int, steps: int = SEARCH_STEPS) -> list[tuple[Filling, int]]:
    """A plan by bin completion, never worse than best-fit decreasing.

    Depth-first: for the largest piece left, fillings in order of waste; each is repeated as
    often as the counts allow. A branch is cut when the waste so far exceeds what one
    sequence fewer than the incumbent would leave. The search ends at the lower bound, which
    proves the plan optimal, or after `steps` nodes. A node tries at most 32 fillings, found
    within one five-hundredth of the steps and no further than the first without waste: so
    the search may end without a proof, and fewer sequences may then be possible.
    """
    incumbent = best_fit(counts, capacity)
    best, bound = sum(n for _, n in incumbent), sequences_needed(counts, capacity)
    total, budget = sum(length * n for length, n in counts.items()), [steps]
    left = Counter({length: n for length, n in counts.items() if n})
    plan: list[tuple[Filling, int]] = []
    stack: list[tuple[Iterator, int, int]] = []  # fillings to try, waste and sequences before

    def choices(waste: int) -> Iterator[Filling]:
        lengths = sorted(left, reverse=True)
        largest, allowed = lengths[0], (best - 1) * capacity - total - waste
        left[largest] -= 1
        exhausted = not left[largest]
        others = lengths[1:] if exhausted else lengths
        own = [min(budget[0], max(200, steps // 500))]
        spent = own[0]
        found: list[Filling] = []
        if not others:
            found = [()]
        else:
            for filling in undominated(capacity - largest, others, left, max(0, allowed), own):
                found.append(filling)
                if sum(filling) == capacity - largest or len(found) == 32:
                    break
        budget[0] -= spent - max(0, own[0]) + 1
        left[largest] += 1
        found.sort(key=lambda f: -sum(f))
        return iter([(largest,) + f for f in found])

    waste = used = 0
    if best > bound:
        stack.append((choices(0), 0, 0))
    while stack and best > bound and budget[0] > 0:
        fillings, waste, used = stack[-1]
        while len(plan) >= len(stack):  # take back what an earlier branch placed
            filling, n = plan.pop()
            for length in filling:
                left[length] += n
        filling = next(fillings, None)
        if filling is None:
            stack.pop()
            continue
        need = Counter(filling)
        n = min(left[length] // m for length, m in need.items())
        waste, used = waste + n * (capacity - sum(filling)), used + n
        if used + -(-(total - used * capacity + waste) // capacity) >= best:
            n_fewer = 1  # all repetitions waste too much; fewer may not
            waste, used = waste - (n - n_fewer) * (capacity - sum(filling)), used - (n - n_fewer)
            n = n_fewer
            if used + -(-(total - used * capacity + waste) // capacity) >= best:
                continue
        for length, m in need.items():
            left[length] -= n * m
            if not left[length]:
                del left[length]
        plan.append((filling, n))
        if not left:
            incumbent, best = list(plan), used
        else:
            stack.append((choices(waste), waste, used))
    return incumbent


# --- from the plan to places


def _shares(plan: list[tuple[Filling, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length: (first number, first sequence, offset, repetitions) of the places it takes, by number."""
    shares: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for filling, n in plan:
        offset = 0
        for length in filling:
            shares.setdefault(length, []).append((taken[length], sequence, offset, n))
            taken[length] += n
            offset += length
        sequence += n
    return shares


def place(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """`pieces` (doc_id, piece, length, ...) with sequence_id and offset; the table must be written, not recomputed."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", *[c for c in pieces.columns if c == "ids_crc32"]), F.lit(salts)).cast("int"))
    groups = {(r["length"], r["_salt"]): r["n"] for r in salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()}
    counts: Counter = Counter()
    first: dict[tuple[int, int], int] = {}
    for (length, salt), n in sorted(groups.items()):
        first[length, salt] = counts[length]
        counts[length] += n
    shares = spark.sparkContext.broadcast(_shares(complete_bins(dict(counts), capacity)))
    starts = spark.sparkContext.broadcast(first)

    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", *[c for c in pieces.columns if c == "ids_crc32"])
    numbered = salted.withColumn("_number", F.row_number().over(order) - 1)
    names = pieces.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts = {length: [s[0] for s in own] for length, own in shares.value.items()}
        for batch in batches:
            places = []
            for length, salt, number in zip(batch["length"], batch["_salt"], batch["_number"]):
                number += starts.value[length, salt]
                begin, sequence, offset, _ = shares.value[length][bisect_right(firsts[length], number) - 1]
                places.append((sequence + number - begin, offset))
            yield batch[names].assign(sequence_id=[p[0] for p in places], offset=[p[1] for p in places])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return numbered.mapInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack all documents into sequences: one row per piece.

    Returns doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32
    (of its little-endian 32-bit ids), sequence_id (from 0, gapless) and offset (its place).
    Every document ends with id 0. Only documents longer than `capacity` are cut; all their
    pieces are full but the first.

    Null and empty texts are the closing id alone. Rows that repeat an id are packed each on
    its own, and null ids are kept as they are. Very long texts are encoded whole. An empty
    table gives no rows; other columns are not read.
    """
    pieces = materialize(tokenised_pieces(pruned(docs, id_column, text_column), tokenizer, capacity), "pieces")
    return place(pieces, capacity)


def write_sequences(docs: DataFrame, layout: DataFrame, tokenizer: str, path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the packed sequences as Parquet: sequence_id, ids (array, in place). Ids must be unique."""
    pieces = tokenised_pieces(pruned(docs, id_column, text_column), tokenizer, capacity, with_ids=True)
    joined = pieces.select("doc_id", "piece", "ids").join(layout.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(group.sort_values("offset")["ids"])
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [np.frombuffer(ids, dtype="<u4").astype("int32")]})

    # a group is one sequence, so at most `capacity` pieces
    joined.groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids array<int>").write.parquet(path)
