"""Small pieces shared by the operators of this subpackage."""

from __future__ import annotations

import shutil
import string
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import deltascope
from deltascope.sources.materialize import materialize, release

__all__ = ["WORD", "fold_ascii", "keep_where", "let", "materialize", "pruned", "release", "ship_package"]

# fixed value: a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty.

    `lower` has a fast path for ASCII text, where it does exactly that; other texts take
    the slower character table.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def pruned(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; whatever else the table has can't clash."""
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, also where `body` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_where(df: DataFrame, flag: str) -> DataFrame:
    """The rows whose `flag` is true.

    The count that is observed on the way keeps the condition from being pushed below the
    projections that work the flag out, where it would be evaluated a second time.
    """
    counted = df.observe(f"{flag}-{uuid.uuid4().hex}", F.count_if(flag).alias("kept"), F.count("*").alias("rows"))
    return counted.where(flag)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, for sessions that were
    started without it on their path."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        _shipped.add(application)
        package = Path(deltascope.__file__).parent
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp()).resolve() / package.name), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
