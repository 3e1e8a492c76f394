"""Small helpers that the operators of this subpackage share."""

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch. Rows hold whole texts, so a batch of the default 10,000 rows would not be bounded in bytes.
BATCH_ROWS = 256
#: A key is hot if it has more than one in this many of all rows, so there are fewer hot keys than this.
HOT_KEYS = 500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` unchanged; its session sends Python tasks at most ``BATCH_ROWS`` rows at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


#: Bytes of text worked on at a time.
PIECE_BYTES = 1 << 21


def give_back():
    """Return freed memory of a Python worker to the system.

    Workers are used again by later stages; without this, what the largest stage needed once stays with each of them.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library keeps its own counsel.
        pass


def pieces(batches, column, limit=PIECE_BYTES):
    """The rows of Arrow ``batches`` again, in batches of at most ``limit`` bytes of text (or one row).

    Work on whole batches of texts takes memory in proportion to their bytes; this bounds it. Freed memory is given back at the end.
    """
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if held and held + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, hot_keys=HOT_KEYS) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key and in ``count`` the number of left rows of that key.

    ``total`` is the sum of these counts, or more. Keys with more than a ``hot_keys``-th of them are fewer than ``hot_keys``, so
    their rows are broadcast and the left rows stay where they are; what is shuffled has no key with more than that share.
    """
    hot = F.col(count) * hot_keys > total
    few = F.broadcast(right.where(hot))
    rest = left.join(few.select(key), key, "left_anti").join(right.where(~hot), key)
    return left.join(few, key).unionByName(rest)
