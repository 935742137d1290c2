"""Records that line ends don't separate, read by many tasks from one file.

A quoted CSV field may hold line breaks, and a JSON array need not hold any. So a task that
starts in the middle of a file can't tell where a record begins: a quote may open a field or
close one that an earlier task opened. Two passes settle it. The first runs over each split
twice, once for either guess (inside quotes or not), and keeps where each guess ends; those
few figures, one row a split, are chained from the start of each file, which leaves the
right guess for every split. The second pass cuts the splits into records. A record that
crosses splits is put together from its pieces, at most two a split.

Files are read as text cut at a separator that ends every record (line feed, or `}`), by
Spark's own reader, which also decides about the splits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from deltascope.sources.workers import ship_package

Advance = Callable[[str, bool], tuple[bool, int]]


@dataclass(frozen=True)
class Grammar:
    """How a text moves on from one separator to the next.

    `advance(chunk, inside)` says whether the end of a chunk and its separator is inside
    quotes, and how many levels deeper than its beginning. A record is complete outside
    quotes, on the level `level(first character of the file)`.
    """

    separator: str
    advance: Advance
    level: Callable[[str], int]
    blank: Callable[[str], bool]  # what is no record, though complete


# --- delimited text


def open_field(sep: str) -> str:
    """A pattern of lines that begin outside quotes and end inside; also valid in Java."""
    s = "\\t" if sep == "\t" else re.escape(sep)
    quoted = r'[^"]*+(?:""[^"]*+)*+'
    # a quote opens a field only as its first character; whatever follows a closing one is
    # taken as it is, up to the delimiter
    return rf'^(?:(?:"{quoted}"[^{s}]*+|[^"{s}][^{s}]*+)?{s})*+"{quoted}$'


def csv_grammar(sep: str) -> Grammar:
    opened, closing = re.compile(open_field(sep)), re.compile(r'[^"]*+(?:""[^"]*+)*+"')

    def advance(line: str, inside: bool) -> tuple[bool, int]:
        if '"' not in line:
            return inside, 0
        if inside:
            found = closing.match(line)
            if found is None:
                return True, 0
            after = line.find(sep, found.end())
            if after < 0:
                return False, 0
            line = line[after + len(sep):]
        return opened.match(line) is not None, 0

    return Grammar("\n", advance, lambda first: 0, lambda line: line in ("", "\r"))


# --- JSON

_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
_STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.DOTALL)


def _json_advance(chunk: str, inside: bool) -> tuple[bool, int]:
    if inside:
        found = _STRING_END.match(chunk)
        if found is None:
            return True, 0
        chunk = chunk[found.end():]
    plain, quote, _ = (_STRING.sub("", chunk) if '"' in chunk else chunk).partition('"')
    deeper = plain.count("{") + plain.count("[") - plain.count("]")
    # the separator is a closing brace, unless it is part of a string
    return (True, deeper) if quote else (False, deeper - 1)


#: An array of objects, or objects one after another.
JSON = Grammar("}", _json_advance, lambda first: 1 if first == "[" else 0, lambda text: "{" not in text)


# --- the two passes

HEAD, WHOLE, TAIL, MIDDLE = range(4)
ROWS_AT_ONCE = 4096


def _chunks(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    text = spark.read.option("lineSep", grammar.separator).text(path)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.coalesce("value", F.lit("")).alias("value")
    )


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """Runs of chunks of one split, in the order of the file; a split may come in several runs."""
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        values, start = batch.column(2).to_pylist(), 0
        for end in range(1, len(values) + 1):
            if end == len(values) or files[end] != files[start] or blocks[end] != blocks[start]:
                yield (files[start], blocks[start]), values[start:end]
                start = end


def _guesses(chunks: DataFrame, grammar: Grammar) -> DataFrame:
    """One row a split: where it ends if it begins outside quotes, and if inside."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        advance, found = grammar.advance, {}
        for split, values in _by_split(batches):
            if split not in found:
                found[split] = [False, 0, True, 0, _first_character(values)]
            (out, out_level, in_, in_level, first), known = found[split], found[split]
            for value in values:
                out, step = advance(value, out)
                out_level += step
                in_, step = advance(value, in_)
                in_level += step
            known[:] = out, out_level, in_, in_level, first
        rows = [(*split, *known) for split, known in found.items()]
        columns = zip(*rows) if rows else [[] for _ in _GUESS.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.string()))],
            names=[c.split()[0] for c in _GUESS.split(", ")],
        )

    return chunks.mapInArrow(run, _GUESS)


def _first_character(values: list[str]) -> str:
    return next((v for v in (value.lstrip("\ufeff").strip()[:1] for value in values) if v), "")


_GUESS = "file bigint, block bigint, outside boolean, outside_level bigint, inside boolean, inside_level bigint, first string"


def _starts(guesses: DataFrame, grammar: Grammar) -> dict[tuple[int, int], tuple[bool, int, int]]:
    """For every split: whether it begins inside quotes, on which level, and the level of records.

    The driver sees one row a split, some 50 bytes for each 128 MB that are read.
    """
    starts, file = {}, None
    for row in sorted(guesses.collect()):
        if row.file != file:
            file, inside, level, complete = row.file, False, 0, grammar.level(row.first)
        starts[row.file, row.block] = (inside, level, complete)
        level += row.inside_level if inside else row.outside_level
        inside = row.inside if inside else row.outside
    return starts


def _cut(chunks: DataFrame, grammar: Grammar, starts: dict) -> DataFrame:
    """`(file, block, part, first, text)`: whole records, and the pieces of those that cross splits."""
    def pieces(split: tuple[int, int], runs: Iterable[list[str]]) -> Iterator[tuple[int, bool, str]]:
        inside, level, complete = starts[split]
        # what an earlier split began is not a record of this one
        part, first, held = HEAD if inside or level > complete else WHOLE, split[1] == 0, []
        for values in runs:
            for value in values:
                inside, step = grammar.advance(value, inside)
                level += step
                held.append(value)
                if inside or level != complete:
                    continue
                text = held[0] if len(held) == 1 else grammar.separator.join(held)
                if part == HEAD or not grammar.blank(text):
                    yield part, first, text
                    first = False
                part, held = WHOLE, []
        if held:
            yield MIDDLE if part == HEAD else TAIL, first, grammar.separator.join(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        for split, runs in groupby(_by_split(batches), key=lambda r: r[0]):
            for piece in pieces(split, (values for _, values in runs)):
                ready.append((*split, *piece))
                if len(ready) == ROWS_AT_ONCE:
                    yield _batch(ready)
                    ready = []
        yield _batch(ready)

    return chunks.mapInArrow(run, "file bigint, block bigint, part int, first boolean, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.int64(), "block": pa.int64(), "part": pa.int32(), "first": pa.bool_(), "text": pa.string()}
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def read_records(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    """`(first, text)`: every record of the files under `path`; `first` marks the first of a file.

    Rows come in no order. What a file holds after its last complete record is a record too,
    unless it is blank.
    """
    ship_package(spark)
    chunks = _chunks(spark, path, grammar)
    found = _cut(chunks, grammar, _starts(_guesses(chunks, grammar), grammar))
    # at most two pieces a split, of which the first is a tail
    in_file = Window.partitionBy("file").orderBy("block", "part")
    crossing = found.where(F.col("part") != WHOLE).withColumn("record", F.count_if(F.col("part") == TAIL).over(in_file))
    pieces = F.array_sort(F.collect_list(F.struct("block", "part", "text")))
    joined = crossing.groupBy("file", "record").agg(F.bool_or("first").alias("first"), pieces.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), grammar.separator)
    return found.where(F.col("part") == WHOLE).select("first", "text").unionByName(joined.select("first", text.alias("text")))
