"""Exact deduplication by a persistent digest index.

The index holds one row per different text, bucketed and sorted by digest. New data is reduced to one row per text, what the
index knows is taken out by a sort-merge anti-join on the digest, and the rest is appended. A batch lies in a partition of its
own and is written over as a whole, so a batch that is added again after a failure changes nothing. Only DataFrame and SQL
functions are used.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import join_counted

#: Characters that don't count when texts are compared: ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"
#: Different texts of a bucket, about 100 MB of index.
BUCKET_ROWS = 2_000_000


def normalised(text):
    """Column: a text without white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, id="doc_id", text="text") -> DataFrame:
    """Slim rows of ``docs``: digest, id, n_chars (code points of the original text), copies (rows equal in all of these).

    Repeated rows are one row here, so a hot text under one id (or under null) never meets in one task.
    """
    digest = F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256))
    rows = docs.select(digest.alias("digest"), F.col(id).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_chars"))
    return rows.groupBy("digest", "id", "n_chars").agg(F.count("*").alias("copies"))


def buckets_for(rows: int) -> int:
    return max(8, -(-rows // BUCKET_ROWS))


class DigestIndex:
    """Index of the texts seen so far, under a path that the driver and all executors share.

    Rows: digest, keep_id and keep_chars (of the row that stays), copies (rows of this text in the batch that brought it), batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        """Open the index at ``path``; any session can, the catalogue needs to know nothing."""
        self.spark, self.path = spark, path.rstrip("/")
        shape = spark.read.parquet(f"{self.path}/shape").first()
        self.buckets, self.name = shape["buckets"], "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:20]
        place = self.path.replace("'", r"\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {shape['id_type']}, keep_chars BIGINT, copies BIGINT, batch STRING) "
            f"USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        spark.catalog.recoverPartitions(self.name)

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int, id_type="bigint"):
        """A new, empty index. ``buckets`` stays as it is; :meth:`compacted` changes it."""
        spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type")).write.parquet(f"{path.rstrip('/')}/shape")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, groups: DataFrame, batch: str) -> DataFrame:
        """Those of ``groups`` (one row per digest) that no other batch has brought."""
        return groups.join(self.rows().where(F.col("batch") != batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str):
        """Add ``groups`` (digest, keep_id, keep_chars, copies) as ``batch``, in place of what the batch held before."""
        view = f"{self.name}_new"
        # One task per bucket, so that a batch adds one sorted file to each.
        groups.repartition(self.buckets, "digest").createOrReplaceTempView(view)
        name = batch.replace("\\", "\\\\").replace("'", r"\'")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{name}') SELECT digest, keep_id, keep_chars, copies FROM {view}")
        self.spark.catalog.dropTempView(view)

    def add(self, slim: DataFrame, batch: str) -> DataFrame:
        """Deduplicate a batch of :func:`digests` rows and append its new texts: id, keep_id, group_size, kept, digest, per row of the batch.

        Of equal texts within a batch the row with the most characters stays, then the one with the smallest id (null last). A
        text that an earlier batch brought stays there: its keep_id is the earlier row's, and none of the batch is kept.
        ``group_size`` counts the rows of the batch and of the batch that brought the text. Rows that repeat in all of digest,
        id and n_chars are told apart by nothing: the first is kept. An empty batch is an empty partition.
        """
        slim = checkpointed(slim)
        order = F.min(F.struct(-F.col("n_chars"), F.col("id").isNull(), F.col("id"))).alias("first")
        groups = slim.groupBy("digest").agg(order, F.sum("copies").alias("copies")).select(
            "digest", F.col("first")["id"].alias("keep_id"), (-F.col("first")["col1"]).alias("keep_chars"), "copies")
        # The table is written over while others of its batches are read: the rows have to be there before.
        groups = checkpointed(groups)
        self.append(checkpointed(self.fresh(groups, batch)), batch)
        known = self.rows().select("digest", "keep_id", "keep_chars", F.col("copies").alias("earlier"), (F.col("batch") == batch).alias("own"))
        stays = groups.select("digest", "copies").join(known.hint("merge"), "digest").select(
            "digest", "keep_id", "keep_chars", "own", F.col("copies").alias("rows"),
            (F.col("copies") + F.when(F.col("own"), 0).otherwise(F.col("earlier"))).alias("group_size"))
        total = slim.count()
        told = join_counted(slim.withColumnRenamed("copies", "same"), stays, "digest", "rows", total)
        first = F.col("own") & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
        return told.select("id", "keep_id", "group_size", "digest", first.alias("first"), F.posexplode(F.sequence(F.lit(1), F.col("same")))).select(
            "id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), (F.col("first") & (F.col("pos") == 0)).alias("kept"), "digest")

    def compacted(self, path: str, buckets: int | None = None):
        """A new index at ``path`` with all rows of this one in one batch: one file per bucket again, and as many buckets as wanted."""
        kind = self.rows().schema["keep_id"].dataType.simpleString()
        other = DigestIndex.create(self.spark, path, buckets or self.buckets, kind)
        other.append(self.rows().drop("batch"), "compacted")
        return other
