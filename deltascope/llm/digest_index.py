"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per
digest first (combined map-side, so a text that a third of all rows share arrives as one
row per task), then anti-joined with the index bucket by bucket: the index side is neither
shuffled nor sorted again. What survives is appended under the same bucketing. Verdicts are
joined back to the rows on the digest; both sides of that join are shuffled, which lets
adaptive execution split the partition of a text with very many copies. Only digests and
ids are ever shuffled, never texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltascope.llm.common import fold_ascii, materialize, pruned
from deltascope.sources.materialize import shared_folder


class DigestIndex:
    """Digests of all texts seen so far, each with the id of the row that stays.

    `path` is where the table's files live, a folder all executors share; by default one
    below `spark.checkpoint.dir`. An index outlives the session: open it again with the same
    path and bucket count, and its files are registered under `table`.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, table: str | None = None, buckets: int = 32):
        self.spark, self.buckets = spark, buckets
        name = uuid.uuid4().hex
        self.table = table or f"digest_index_{name}"
        self.path = path or f"{shared_folder(spark)}/digest-index-{name}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def add(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Deduplicate a batch against itself and everything indexed before, and index what is new.

        Returns one row per row of `docs`: doc_id, keep_id (the row that stays), group_size
        (equal texts in this batch), kept, known (an earlier batch had the text) and
        text_sha256. Texts are equal when identical after lower-casing A-Z.

        Null text counts as empty; all empty texts are one group. Of equal texts the largest
        id stays; rows that repeat that id with the same text are one document and share its
        verdict. A null id never wins over another id; if a group has no other, its rows
        have a null keep_id and stay. An empty batch gives no rows and adds nothing.
        """
        digested = materialize(
            pruned(docs, id_column, text_column).select(
                F.col("doc_id").cast("long"), F.unhex(F.sha2(fold_ascii(F.col("text")).cast("binary"), 256)).alias("digest")
            ),
            "digests",
        )
        groups = digested.groupBy("digest").agg(F.max("doc_id").alias("batch_id"), F.count("*").alias("group_size"))
        groups = materialize(groups, "digest-groups")
        known = self.spark.table(self.table)
        fresh = groups.join(known.hint("merge"), "digest", "left_anti").select("digest", F.col("batch_id").alias("keep_id"))
        # written aside first: a table can't be read and appended to in one job
        fresh = materialize(fresh, "digests-fresh")
        (
            fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)
        verdicts = materialize(
            groups.join(self.spark.table(self.table).hint("merge"), "digest").join(
                fresh.select("digest", F.lit(False).alias("known")), "digest", "left"
            ),
            "digest-verdicts",
        )
        return digested.join(verdicts, "digest").select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.coalesce("known", F.lit(True))).alias("kept"),
            F.coalesce("known", F.lit(True)).alias("known"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
