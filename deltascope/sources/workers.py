"""The package itself on the Python workers of a cluster."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import deltascope

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
