"""Removal of line chunks that repeat anywhere in the corpus.

A rolling hash runs over the hashes of neighbouring worded lines. A chunk reaches as far as
its windows are met elsewhere: its boundaries lie where a window is met for the first time,
so they follow from nearby lines alone and move along when lines are inserted before them.
A window is two worded lines, or one line of many words. Of windows that are equal byte for
byte, as the SHA-256 of their bytes tells, the first (smallest document, then line) stays
and the lines of the others are cut out. The first occurrence of a line in the corpus is in
no later window, so it always stays.

Nothing but hashes is shuffled to find repeats: 64 bits of every window are counted,
combined map-side, and met by a sort-merge join at any size, since the hashes found twice
grow with the corpus; digests of what is left are grouped. A window that a third of all
documents share is one group of partial counts, and its occurrences are matched in a join
whose skewed partitions adaptive execution splits. Texts are moved once, to be cut. No list
ever holds more than one document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deltascope.llm.common import WORD, keep_where, let, materialize, release

#: A line of so many words is a chunk by itself.
LONG_LINE = 50

_WORDED = r"[^\x20\x09-\x0D]"


def _windows(lines: Column) -> Column:
    """Two worded lines in a row, and every long line: first line, the line after, rolling hash, digest of the bytes."""
    def window(first: Column, last: Column, rolled: Column, body: Column) -> Column:
        return F.struct(
            first.alias("first"), (last + 1).alias("after"), rolled.alias("hash"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest")
        )

    def over(texts: Column, places: Column) -> Column:
        def text(place: Column) -> Column:
            return F.get(texts, place)

        def pair(first: Column, last: Column) -> Column:
            rolled = F.xxhash64(F.xxhash64(text(first)), F.xxhash64(text(last)))
            return window(first, last, rolled, F.concat_ws("\n", text(first), text(last)))

        # a text of so many words has about twice as many characters at least
        long = F.filter(places, lambda p: (F.length(text(p)) >= 2 * LONG_LINE - 1) & (F.regexp_count(text(p), F.lit(WORD)) >= LONG_LINE))
        alone = F.transform(long, lambda p: window(p, p, F.xxhash64(text(p)), text(p)))
        pairs = F.transform(F.slice(places, F.lit(1), F.greatest(F.size(places) - 1, F.lit(0))), lambda p, k: pair(p, F.get(places, k + 1)))
        return F.concat(pairs, alone)

    def worded(texts: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(texts) - 1), lambda i: F.get(texts, i).rlike(_WORDED))

    return let(lines, lambda texts: let(worded(texts), lambda places: over(texts, places)))


def _copies(keyed: DataFrame) -> DataFrame:
    """(_id, _of, first, after): all lines of every text with a word that a smaller id has too, byte for byte by SHA-256."""
    digests = materialize(keyed.where(F.col("_text").rlike(_WORDED)).select(
        "_id", "_of", F.sha2(F.col("_text").cast("binary"), 256).alias("digest"), F.size(F.split("_text", "\n")).alias("after")
    ), "text-digests")
    place = F.struct("_id")
    kept = digests.groupBy("digest").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = digests.join(kept.hint("merge"), "digest").where(~place.eqNullSafe(F.col("kept")))
    return later.select("_id", "_of", F.lit(0).alias("first"), "after")


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", copies: bool = False) -> DataFrame:
    """Cut repeated chunks out of every text: one row per row of `docs`.

    With `copies`, a text that repeats another one as a whole loses all its lines, also if it
    has a single short one; the smallest id keeps the text.

    Returns the columns of `docs` in the struct `_doc`, `clean_text`, `n_lines` and
    `n_removed_lines`. Lines are split at line feeds and compared as they are; lines
    without a word between those of a chunk are cut with it and not compared.

    A null text has 0 lines and a null clean_text; an empty one has 1 line and stays empty.
    Chunks inside one document count as repeats too. Rows that repeat an id with the same
    text are one document: they share their verdicts, and none is a repeat of the other. A
    null id comes first. A text may lose all its lines and is then empty. An empty table
    gives no rows; extra columns stay inside the struct and can't clash.
    """
    text = F.col(f"`{text_column}`")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col(f"`{id_column}`").alias("_id"), F.xxhash64(text).alias("_of"), text.alias("_text"),
    )
    windows = keyed.where(F.col("_text").isNotNull()).select(
        "_id", "_of", F.explode(_windows(F.split("_text", "\n"))).alias("w")
    ).select("_id", "_of", "w.*")
    windows = materialize(windows, "windows")
    met_again = materialize(windows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "window-hashes")
    suspects = materialize(windows.join(met_again.hint("merge"), "hash", "left_semi").drop("hash"), "window-suspects")
    release(windows)
    place = F.struct("_id", "first", "_of")
    kept = suspects.groupBy("digest").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = suspects.join(kept, "digest").where(~place.eqNullSafe(F.col("kept")))
    span = F.struct("first", "after")
    found = repeats.select("_id", "_of", "first", "after", F.lit(False).alias("whole"))
    if copies:
        found = found.unionAll(_copies(keyed).withColumn("whole", F.lit(True)))
    cuts = materialize(found.groupBy("_id", "_of").agg(
        F.coalesce(F.max(F.when(F.col("whole"), F.array(span))), F.collect_set(span)).alias("_cuts")
    ), "chunk-cuts").select(F.col("_id").alias("_cut_id"), F.col("_of").alias("_cut_of"), "_cuts")

    joined = keyed.join(cuts.hint("merge"), keyed["_id"].eqNullSafe(cuts["_cut_id"]) & (keyed["_of"] == cuts["_cut_of"]), "left")
    removed = F.array_distinct(F.flatten(F.transform("_cuts", lambda c: F.sequence(c["first"], c["after"] - 1))))

    def remaining(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    return joined.select(
        "_doc",
        F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(let(F.split("_text", "\n"), remaining)).alias("clean_text"),
        F.coalesce(F.size(F.split("_text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed_lines"),
    )


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with repeated chunks cut out; exact copies and those left without a word by it are gone."""
    cleaned = dedup_lines(docs, id_column, text_column, copies=True)
    emptied = (F.col("n_removed_lines") > 0) & ~F.coalesce(F.col("clean_text").rlike(_WORDED), F.lit(False))
    return keep_where(cleaned.withColumn("_left", ~emptied), "_left").select(*[
        F.col("clean_text").alias(c) if c == text_column else F.col("_doc").getField(c).alias(c) for c in docs.columns
    ])
