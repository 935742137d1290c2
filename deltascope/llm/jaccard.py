"""Near duplicates: an exact Jaccard join on word shingles, and its connected components.

Signatures. Two sets with Jaccard similarity of at least t have a bounded symmetric
difference, at most D for the sizes of a band. The universe of shingles is parted by a hash
into segments. Of D + 1 segments compared for equality at least one must agree; a segment
that is also compared after leaving out any one shingle (its one-deletion neighbourhood)
counts for two. How many segments of which kind a band uses is allocated by cost: rows of
signatures against the accidental agreements expected from the number of documents in the
band. Extra segments let a set leave out as many: its empty ones, which would agree by
chance, and then the signatures that most documents have, as those of common passages. All
sets leave out by one order of all signatures, so of the segments two linked sets agree in,
one more than the extra ones, the last in that order is left out by neither.

Links. Sets that are equal become one node first. Only signatures met at least twice are
looked at further. Every member of such a signature is compared with one hub of it; members
that stay in different components are compared with another hub, and last with each other,
so no link is lost while a group of thousands of linked copies never becomes all pairs.
Every node has a sketch, the parities of its shingles in some eight buckets per allowed
difference. Two sets differ in at least as many shingles as their sketches differ in bits,
so a join passes on only pairs that may be linked, and is still exact; of unlinked pairs
hardly any passes that is not at the limit itself. What passes is verified on the whole
sets. A set is handled as its 64-bit shingle hashes.

Hot signatures: counted map-side, then met in a join whose skewed partitions adaptive
execution splits; no task holds the members of a signature as a list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from deltascope.llm.common import materialize, pruned, release

GROWTH = 1.4  # of the sizes from one band to the next
LARGEST = 2**26  # shingles; bands beyond it aren't needed, larger sets share the last
VERIFY_COST = 40  # comparing a pair, in rows of signatures
COMMON = 0.05  # share of a set's shingles that many others may have, as far as the cost model knows
HASH_BITS = 41  # highest of a signature; more would tell apart what is more than all shingles of 100 GB
BAND_BITS = 7  # below them: its band (bands are fewer than 64), and whether a shingle was left out; the rest is zero, for shuffles
REST = 64 - HASH_BITS - BAND_BITS
HUB_ROUNDS = 2  # comparisons with single hubs before members are compared with each other
SKETCH_BITS = 8  # per shingle of allowed difference, rounded to a power of two
SPARE_BITS = 6  # of a signature's prefix, beyond what tells all signatures apart on average

# --- sets


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits evenly (a public finaliser of multiplications and shifts)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of words seen by this Python worker; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype="u8")


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words, A-Z lower-cased; of the whole sequence if it is shorter."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not own:
        return np.empty(0, dtype="u8")
    hashes = np.fromiter(map(_hashes.__getitem__, own), dtype="u8", count=len(own))
    n = min(words, len(own))
    total = np.full(len(own) - n + 1, n, dtype="u8")
    for k in range(n):
        total = _mix(total + hashes[k:len(own) - n + 1 + k] * _FACTORS[k % 5] + np.uint64(k // 5))
    return np.unique(total)


# --- bands and what they compare


@dataclass(frozen=True)
class Band:
    """Sets of `low` to `high` shingles and their partners of at least their own size."""

    low: int
    high: int
    exact: int  # segments compared as they are
    deletion: int  # segments also compared after leaving one shingle out
    extra: int  # how many exact segments a set may leave out


def difference(total: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets with `total` shingles together."""
    return total - 2 * -(-percent * total // (100 + percent))


def band_limits(percent: int) -> list[tuple[int, int]]:
    limits, low = [], 1
    while low < LARGEST:
        high = max(low, math.ceil(low * GROWTH) - 1)
        limits.append((low, high))
        low = high + 1
    return limits


def _extras(needed: int) -> Iterator[int]:
    """Numbers of extra segments the allocation considers: all small ones, then in steps of a twentieth."""
    extra = 0
    while extra <= needed:
        yield extra
        extra = max(extra + 1, extra * 21 // 20)


def _more_than(limit: int, expected: float) -> float:
    """Probability of a Poisson number to be larger than `limit`; roughly, for large ones."""
    if expected > 100:
        return math.erfc((limit + 0.5 - expected) / math.sqrt(2 * expected)) / 2
    term, below = math.exp(-expected), 0.0
    for k in range(limit + 1):
        below += term
        term *= expected / (k + 1)
    return max(0.0, 1 - below)


def allocate(low: int, high: int, percent: int, documents: float) -> Band:
    """The cheapest way to compare the sets of a band that finds every linked pair."""
    largest = high + high * 100 // percent
    bound = max(difference(t, percent) for t in range(max(2, largest - 20), largest + 1))
    best = None
    for deletion in range(min(4, (bound + 1) // 2 + 1) + 1):
        if deletion and 2 * (deletion - 1) >= bound + 1:
            continue
        needed = max(0, bound + 1 - 2 * deletion)
        for extra in _extras(needed):
            exact = needed + extra
            segments = exact + deletion
            # a segment without a rare shingle agrees by chance
            idle = (1 - (1 - COMMON) / segments) ** low
            expected = exact * idle
            exposed = _more_than(extra, expected)
            pairs = documents / 2 * (exposed**2 * max(1.0, expected - extra) * max(1.0, expected) / max(1, exact) + deletion * idle**2 * (1 + 2 * low / segments))
            cost = segments + deletion * low / segments + VERIFY_COST * pairs
            if best is None or cost < best[0]:
                best = cost, Band(low, high, exact, deletion, extra)
    return best[1]


def bands_of(size: int, bands: tuple[Band, ...], percent: int) -> list[int]:
    """Bands whose comparison a set takes part in: its own, and those of possible smaller partners."""
    own = next((k for k, b in enumerate(bands) if size <= b.high), len(bands) - 1)
    smallest = -(-size * percent // 100)
    found = [own]
    while found[-1] and bands[found[-1] - 1].high >= smallest:
        found.append(found[-1] - 1)
    return found


def signed_set(own: np.ndarray, bands: tuple[Band, ...], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that any two linked sets share at least one of, and what a set may still leave out.

    The first hold their band below the hash. The second are one number a band with exact
    segments, in the same form: how many signatures of that band may go, by any order that
    is the same for all sets.
    """
    found, spare = [], []
    for k in bands_of(len(own), bands, percent):
        band = bands[k]
        count = band.exact + band.deletion
        where = ((_mix(own + np.uint64(k + 1)) >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        value = _mix(own ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        low = np.bincount(where, (value & np.uint64(0xFFFFFFFF)).astype("f8"), count).astype("u8")
        high = np.bincount(where, (value >> np.uint64(32)).astype("f8"), count).astype("u8")
        content = low + (high << np.uint64(32))  # a sum, so order plays no part and one shingle can be taken out
        place = _mix(np.arange(count, dtype="u8") + np.uint64(k << 40))
        sizes = np.bincount(where, minlength=count)
        emptied = np.flatnonzero(sizes[:band.exact] == 0)[:band.extra]
        use = np.ones(count, dtype=bool)
        use[emptied] = False
        found.append(_in_band(content[use] ^ place[use], np.where(np.flatnonzero(use) < band.exact, k, k + 64)))
        if band.exact:
            spare.append((band.extra - len(emptied) << BAND_BITS) + k << REST)
        if band.deletion:
            out = where >= band.exact
            found.append(np.unique(_in_band((content[where[out]] - value[out]) ^ place[where[out]], k + 64)))
    return np.concatenate(found), np.array(spare, dtype="u8")


def _in_band(x: np.ndarray, band: int | np.ndarray) -> np.ndarray:
    free = np.uint64(64 - HASH_BITS)
    return _mix(x) >> free << free | np.asarray(band, dtype="u8") << np.uint64(REST)


def signatures(own: np.ndarray, bands: tuple[Band, ...], percent: int) -> np.ndarray:
    """Hashes that any two linked sets share at least one of."""
    return np.unique(signed_set(own, bands, percent)[0])


def sketch(own: np.ndarray, percent: int) -> np.ndarray:
    """Parity of the number of shingles in each of a power of two of buckets, 64 to a word."""
    words = 1 << max(0, round(math.log2(max(1, difference(2 * len(own), percent) * SKETCH_BITS / 64))))
    bucket = (_mix(own + np.uint64(0x1234567)) % np.uint64(words * 64)).astype(np.int64)
    odd = (np.bincount(bucket, minlength=words * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether two nodes (struct columns with n and sketch) can be similar enough by size and sketch."""
    n, m, left, right = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.sketch"), F.col(f"{b}.sketch")
    total = n + m
    allowed = total - 2 * F.ceil(percent * total / (100 + percent))

    def folded(x: Column) -> Column:  # to half as many buckets
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def apart(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k)

    # linked sets differ so little in size that their sketches differ by one doubling at most
    bits = F.when(F.size(left) == F.size(right), apart(left, right)).when(
        F.size(left) > F.size(right), apart(folded(left), right)).otherwise(apart(left, folded(right)))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (bits <= allowed)


# --- jobs


def _by_shuffle(df: DataFrame) -> DataFrame:
    """The side of a join that meets the other by a shuffle: a small table is not collected by the driver to be broadcast."""
    return df.hint("merge")


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[list[tuple[int | None, str | None]]]:
    """(id, text) of a few rows at a time, so that a task holds few sets at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype("i4")
    flat = np.concatenate(values) if values else np.empty(0, dtype="u8")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view("i8")))


_SIGNED = "doc_id long, n long, low long, high long, signatures array<long>, spare array<long>, sketch array<long>"


def _signed(docs: DataFrame, bands: tuple[Band, ...], words: int, percent: int) -> DataFrame:
    """Size, 128-bit digest, signatures, how many of them may go, and sketch of every document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches):
            ids, sizes, digests, signed, spares, sketches = [], [], [], [], [], []
            for doc_id, text in rows:
                own = shingles(text, words)
                ids.append(doc_id)
                sizes.append(len(own))
                digests.append((_mix(own + np.uint64(1)).sum(dtype="u8"), _mix(own + np.uint64(2)).sum(dtype="u8")))
                found, spare = signed_set(own, bands, percent) if len(own) else (own, own)
                signed.append(found)
                spares.append(spare)
                sketches.append(sketch(own, percent))
            pairs = np.array(digests, dtype="u8").reshape(-1, 2).view("i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), _lists(signed), _lists(spares), _lists(sketches)],
                ["doc_id", "n", "low", "high", "signatures", "spare", "sketch"],
            )

    return docs.mapInArrow(run, _SIGNED)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), _lists([shingles(r[1], words) for r in rows])], ["node", "own"]
            )

    return docs.mapInArrow(run, "node long, own array<long>")


def _band(column: str) -> Column:
    return F.shiftrightunsigned(column, REST).bitwiseAND(2**BAND_BITS - 1)


def _without_commonest(met: DataFrame, spare: DataFrame) -> DataFrame:
    """`(node, signature)`: the signatures but for those of each node and band met most, as many as it may leave out."""
    place = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("met"), "signature"))
    placed = met.join(_by_shuffle(spare), ["node", "band"], "left").withColumn("place", place)
    return placed.where(F.col("place") > F.coalesce("spare", F.lit(0))).select("node", "signature")


def _with_sketches(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """`(a, b, one, two)`: pairs with size and sketch of both nodes."""
    shown = F.struct("n", "sketch")
    one, two = nodes.select(F.col("node").alias("a"), shown.alias("one")), nodes.select(F.col("node").alias("b"), shown.alias("two"))
    return pairs.join(_by_shuffle(one), "a").join(_by_shuffle(two), "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("own").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    met = pairs.join(_by_shuffle(left), "a").join(_by_shuffle(right), "b")
    return met.where(100 * shared >= percent * (F.size("_a") + F.size("_b") - shared)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b); a component is named by its smallest node.

    Every round ties larger neighbours to the smallest one, then smaller ones among
    themselves, until only stars are left: a logarithmic number of rounds.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).distinct()
    edges = materialize(edges, "edges")
    state = None
    while True:
        ways = edges.union(edges.select(F.col("component").alias("node"), F.col("node").alias("component")))
        least = ways.groupBy("node").agg(F.min("component").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = ways.where("component > node").join(_by_shuffle(least), "node").select(F.col("component").alias("node"), F.col("least").alias("component")).distinct()
        least = large.groupBy("node").agg(F.min("component").alias("least"))
        small = large.join(_by_shuffle(least), "node")
        tied = small.select(F.col("component").alias("node"), F.col("least").alias("component")).union(small.select("node", F.col("least").alias("component")))
        seen = Observation()
        edges = materialize(tied.where("node != component").distinct().observe(
            seen, F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("node", "component"), F.lit(2**31))).alias("checksum")
        ), "edges")
        if seen.get == state:
            return edges.groupBy("node").agg(F.min("component").alias("component"))
        state = seen.get


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).withColumnRenamed("node", "_node")
    return nodes.join(_by_shuffle(found), nodes["node"] == found["_node"], "left").withColumn("component", F.coalesce("component", "node")).drop("_node")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Components of documents whose sets of shingles have a Jaccard similarity of `percent` or more.

    Returns one row per row of `docs`: doc_id, n_shingles and component_id, the smallest id
    reachable by links, the document's own included. Words are runs of anything but ASCII
    white space, A-Z lower-cased; a text with fewer than `words` words is one shingle.

    Null texts and texts without a word have no shingles and are linked with nothing. Ids
    should be unique: rows that repeat an id with the same text share a component; with
    different texts each is judged by its own, as one node where both stand for others. Rows
    without an id get a null component. An empty table gives no rows; other columns are not
    read.
    """
    whole = pruned(docs, id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    limits = band_limits(percent)
    # documents per band, by a rough number of words; only the cost model uses it
    rough = F.least(F.greatest(F.octet_length("text") / 6, F.lit(1)), F.lit(LARGEST))
    counted = {r["k"]: r["n"] for r in whole.where("text IS NOT NULL").groupBy(
        F.floor(F.log(rough) / math.log(GROWTH)).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}

    def around(low: int) -> int:
        k = int(math.log(low) / math.log(GROWTH))
        return sum(counted.get(k + d, 0) for d in (-1, 0, 1))

    bands = tuple(allocate(low, high, percent, max(1000, around(low))) for low, high in limits)
    signed = materialize(_signed(whole, bands, words, percent), "signed-sets")

    # equal sets are one node, named by their smallest id
    digest = ["n", "low", "high"]
    rows = materialize(signed.select("doc_id", *digest, "sketch"), "set-digests")
    nodes = materialize(
        rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*digest).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "nodes"
    )
    others = materialize(
        rows.where("n > 0").select("doc_id", *digest).join(_by_shuffle(nodes.where("copies > 1")), digest).where("doc_id != node").select("doc_id"), "copies"
    )
    members = signed.where("n > 0 AND doc_id IS NOT NULL").join(_by_shuffle(others), "doc_id", "left_anti").select(
        F.explode("signatures").alias("signature"), F.col("doc_id").alias("node")  # in this order a shuffled row compresses best
    )
    # most signatures are met once; a prefix long enough for their number tells that, and
    # what passes by chance has no other member to be compared with
    expected = sum(n * GROWTH**k for k, n in counted.items() if k is not None)
    prefix = F.shiftrightunsigned("signature", max(64 - HASH_BITS, 64 - SPARE_BITS - math.ceil(math.log2(max(2, expected)))))
    shared = members.select(prefix.alias("prefix")).groupBy("prefix").agg(F.count("*").alias("met")).where("met > 1")
    met = members.join(_by_shuffle(shared), prefix == shared["prefix"]).select("node", "signature", "met", _band("signature").alias("band"))
    spare = signed.where("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), F.explode("spare").alias("spare"))
    spare = spare.groupBy("node", _band("spare").alias("band")).agg(F.min(F.shiftright("spare", REST + BAND_BITS)).alias("spare"))
    members = materialize(_without_commonest(met, spare), "members")
    release(signed)

    involved = members.select("node").distinct()
    known = rows.select(F.col("doc_id").alias("node"), "n", "sketch").join(_by_shuffle(involved), "node", "left_semi").dropDuplicates(["node"])
    known = materialize(known, "involved")
    placed = materialize(members.withColumn("component", F.col("node")), "placed-members")
    release(members)
    members = placed

    links = None
    for round_ in range(HUB_ROUNDS + 1):
        # signatures whose members are not yet all in one component
        open_ = members.groupBy("signature").agg(F.min("component").alias("_from"), F.max("component").alias("_to")).where("_from != _to")
        rest = members.join(_by_shuffle(open_.select("signature")), "signature", "left_semi")
        if round_ < HUB_ROUNDS:
            # each round takes another hub, and every member elsewhere is compared with it:
            # no more pairs than members, so sketches meet the pairs and not the signatures
            order = F.xxhash64("node", F.lit(round_)) if round_ else F.col("node")
            hubs = rest.groupBy("signature").agg(F.min_by(F.struct("node", "component"), order).alias("hub"))
            met = rest.join(_by_shuffle(hubs), "signature").where("component != hub.component")
            pairs = met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
            pairs = _with_sketches(pairs, known).where(_may_link("one", "two", percent)).select("a", "b")
        else:
            # of the pairs that are left none is passed on before its sketches are compared
            one = rest.join(_by_shuffle(known), "node").select("signature", F.struct("node", "component", "n", "sketch").alias("one"))
            two = one.select("signature", F.col("one").alias("two"))
            apart = (F.col("one.node") < F.col("two.node")) & (F.col("one.component") != F.col("two.component"))
            met = one.alias("x").join(_by_shuffle(two.alias("y")), (F.col("x.signature") == F.col("y.signature")) & apart & _may_link("one", "two", percent))
            pairs = met.select(F.col("one.node").alias("a"), F.col("two.node").alias("b")).distinct()
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            continue
        met_nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        texts = whole.join(_by_shuffle(met_nodes), whole["doc_id"] == met_nodes["node"], "left_semi")
        found = materialize(_linked(pairs, materialize(_sets(texts, words), "sets"), percent), "links")
        links = found if links is None else links.union(found)
        if round_ < HUB_ROUNDS:
            placed = materialize(_named(members.drop("component"), links), "placed-members")
            release(members)
            members = placed

    named = nodes.withColumn("component", F.col("node")) if links is None else _named(nodes, links)
    named = named.select(*[F.col(c).alias(f"_{c}") for c in digest], "component")
    same = [rows[c] == named[f"_{c}"] for c in digest]
    return rows.join(_by_shuffle(named), same[0] & same[1] & same[2], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with the smallest id of each component, all columns as they are; rows without an id stay."""
    found = near_duplicates(docs, words, percent, id_column, text_column)
    others = materialize(found.where("doc_id != component_id").select(F.col("doc_id").alias("_other")).distinct(), "near-copies")
    return docs.join(others, docs[id_column] == others["_other"], "left_anti")
