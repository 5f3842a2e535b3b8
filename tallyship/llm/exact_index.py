"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the digest of the normalised
text. A batch is deduplicated within itself by aggregation, then against the index
by a sort-merge anti-join that reads the index bucket by bucket without a shuffle
of it, and what is new is appended under the batch's name, so that a batch that is
given again after a failure finds its own rows and not duplicates. Only digests,
ids and lengths are shuffled to reach a verdict, never texts, and all steps are
DataFrame operations.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyship.llm.shared import discard, exists, free_names, matching_rows, shared_dir, stored, text_or_empty

#: ASCII white space, deleted before texts are compared: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

#: Digests of the first batch for which an index gets a bucket, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 20, 16


def without_blanks(text: Column) -> Column:
    """The text with every ASCII white-space character deleted."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


class DigestIndex:
    """A digest index at ``path``; later sessions attach to it by the same path.

    The number of buckets is fixed when the first batch comes: ``buckets``, or one for
    every ``BUCKET_ROWS`` texts of that batch. It is kept beside the table, and
    attaching with another number is an error. Batches come one after another.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        self.wanted, self.buckets = buckets, None
        if exists(spark, f"{self.path}/about/_SUCCESS"):
            self.buckets = spark.read.parquet(f"{self.path}/about").first().buckets
            if buckets not in (None, self.buckets):
                raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
            self._attach()

    def _attach(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, n_chars BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )

    def _create(self, rows: int) -> None:
        self.buckets = self.wanted or max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
        self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about")
        self._attach()

    def detach(self, files: bool = False) -> None:
        """Takes the table out of the session's catalog; its files stay, unless they are to go too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if files:
            discard(self.spark, self.path)

    def rows(self) -> DataFrame:
        """The index: digest, keep_id, n_chars, batch."""
        return self.spark.table(self.table)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, batch: str | None = None) -> DataFrame:
        """Deduplicates a batch, appends what is new, and reports on every row.

        Returns one row per input row, dropped ones too: doc_id, keep_id (the row
        that stays), group_size (rows of the batch with this text), kept,
        text_sha256 (of the normalised text) and n_chars (of the original).

        Of equal texts the row with the most code points in the original text
        stays, then the smallest id; a null id comes after all others, and of
        wholly equal rows exactly one stays. If the index has the text already,
        no row of the batch stays and keep_id is the index's. A null text counts
        as empty, and all empty texts are one group. An empty batch gives no rows
        and leaves the index as it is. Columns other than the two are not read.

        ``batch`` names the batch. A batch of the same name as one before it is that
        one, given again: rows that it has appended do not count against it, what is
        missing is appended, and its verdicts are the same.

        The rows of a large group are spread over ``salts`` keys for the join that
        brings them the verdict, so no task holds a whole group.
        """
        text, batch = text_or_empty(text_col), batch or uuid.uuid4().hex
        rows = stored(
            docs.select(
                F.monotonically_increasing_id().alias("row_id"),
                F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                F.unhex(F.sha2(without_blanks(text).cast("binary"), 256)).alias("digest"),
                F.length(text).cast("bigint").alias("n_chars"),
            ),
            "digests",
        ).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
        best = F.struct(
            F.col("n_chars"), F.col("doc_id").isNotNull().alias("has_id"), F.bitwise_not("doc_id").alias("low_id"),
            F.bitwise_not("row_id").alias("low_row"), F.col("doc_id"), F.col("row_id"),
        )
        groups = stored(
            rows.groupBy("digest")
            .agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"), F.collect_set("salt").alias("salts"))
            .select("digest", F.col("best.doc_id").alias("first_id"), F.col("best.row_id").alias("first_row"), F.col("best.n_chars").alias("n_chars"), "group_size", "salts"),
            "digest-groups",
        )
        if self.buckets is None:
            self._create(groups.count())
        before = self.rows()
        known = stored(groups.join(before.where(F.col("batch") != batch).hint("merge"), "digest").select("digest", F.col("keep_id").alias("known_id")), "digest-known")
        fresh = groups.join(before.hint("merge"), "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id"), "n_chars", F.lit(batch).alias("batch"))
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))  # the bucket that the writer uses, so one task writes it
        fresh.repartition(self.buckets, bucket).sortWithinPartitions("digest").write.mode("append").insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

        verdicts = groups.join(known.withColumn("was_known", F.lit(True)), "digest", "left").where((F.col("group_size") > 1) | F.col("was_known"))
        salted = verdicts.select("digest", F.explode("salts").alias("salt"), "first_id", "first_row", "group_size", "known_id", F.coalesce("was_known", F.lit(False)).alias("was_known"))
        alone = F.col("first_row").isNull()
        return rows.join(salted, ["digest", "salt"], "left").select(
            "doc_id",
            F.when(alone, F.col("doc_id")).when(F.col("was_known"), F.col("known_id")).otherwise(F.col("first_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
            (alone | (~F.col("was_known") & (F.col("row_id") == F.col("first_row")))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "n_chars",
        )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Deduplicates one batch against a fresh index, which goes again; see ``DigestIndex.ingest``."""
    spark = docs.sparkSession
    index = DigestIndex(spark, shared_dir(spark, "index"), buckets)
    verdicts = index.ingest(docs, id_col, text_col).drop("n_chars")
    index.detach(files=True)  # the verdicts do not read it
    return verdicts


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The documents that stay (see ``DigestIndex.ingest``), with all their columns, whatever their names.

    A null text counts as empty, so one of all null and empty texts stays; of ties the
    smallest id, and of rows that agree in id and text one. No rows give no rows. The
    documents themselves are shuffled once, to meet the ids and digests of those that stay.
    """
    text = text_or_empty(text_col)
    key = {"id": F.col(f"`{id_col}`").cast("bigint"), "digest": F.sha2(without_blanks(text).cast("binary"), 256), "chars": F.length(text).cast("bigint")}
    verdicts = index.ingest(docs, id_col, text_col, batch=batch).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"), F.col("n_chars").alias("chars"), "kept")
    alike = stored(verdicts.groupBy("id", "digest", "chars").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("kept").drop("kept"), "kept-rows")
    return matching_rows(docs, key, alike)
