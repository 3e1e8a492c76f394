"""Finding the texts, and the places in them, that can share a window with another place at all.

Each window is marked by the smallest hash of the grams inside it. Equal windows have equal marks, so a mark that occurs at one
place only rules its windows out. Only marks are shuffled for that, not texts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import through_parquet
from .common import pieces, small_batches
from .rolling import mixed, sliding_min

#: A mark at more places than this is hot: its windows are dealt out one by one instead of together.
HOT = 5_000
#: Bytes of text marked at a time: arrays of a number for each byte stay in the processor's cache.
MARKED_BYTES = 1 << 18


def text_key(text):
    """Column: 128 bits that stand for a text; null and empty are the same."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def window_marks(gram, owner, size):
    """Mark of each window of ``size`` grams in a row that lies in one text, and its first place.

    ``gram`` has a hash per place, ``owner`` the text of each place; places near the end of a text may hold anything, as
    long as ``owner`` (of the last element of the gram's window) tells the windows apart that cross the end.
    """
    if len(gram) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    smallest = sliding_min(gram, size)
    at = np.flatnonzero(owner[:len(smallest)])
    return smallest[at], at


def per_text(owner, marks, gram_owner, gram):
    """Different marks of each text, and at how many places of the text the gram of the mark stands."""
    salted = lambda o, g: mixed(g ^ mixed(o.astype(np.uint64), 21), 22)
    wanted, first = np.unique(salted(owner, marks), return_index=True)
    # Few grams are marks: only those that agree with one in 20 bits are told apart by sorting.
    short = lambda g: (g & np.uint64((1 << 20) - 1)).astype(np.int64)
    some = np.zeros(1 << 20, bool)
    some[short(marks)] = True
    likely = some[short(gram)]
    places = np.sort(salted(gram_owner[likely], gram[likely]))
    times = np.searchsorted(places, wanted, "right") - np.searchsorted(places, wanted, "left")
    return owner[first], marks[first], times


def candidates(docs: DataFrame, marks_of, text="text", hot=HOT, id=None) -> DataFrame:
    """Different texts that share a mark with another text, or have one at two places: key, text, marks (of those, with ``hot``).

    ``marks_of`` maps an Arrow text column to (text number, mark, times) arrays. With ``id`` a text goes by that column (which
    takes the place of key), not by its content. The rows are kept in the shared folder.
    """
    name = id or "key"
    content = F.coalesce(F.col(text), F.lit("")) if id is None else F.col(text)
    keyed = docs.select((F.col(id) if id else text_key(F.col(text))).alias(name), content.alias("text"))
    keyed = keyed.withColumn("ref", F.xxhash64(name))

    def mark(batches):
        for batch in pieces(batches, "text", MARKED_BYTES):
            owner, marks, times = marks_of(batch.column("text"))
            yield pa.RecordBatch.from_pydict({
                "ref": batch.column("ref").take(pa.array(owner)), "mark": pa.array(marks.view(np.int64)),
                "times": pa.array(times.astype(np.int32))})

    marked = small_batches(keyed.select("ref", "text")).mapInArrow(mark, "ref bigint, mark bigint, times int")
    # Copies of a text have the same ref: they alone don't make a mark shared.
    several = (marked.groupBy("mark").agg(F.min("ref").alias("a"), F.max("ref").alias("b"), F.max("times").alias("t"), F.sum("times").alias("n"))
               .where("a <> b OR t > 1").select("mark", (F.col("n") > hot).alias("hot")))
    found = (marked.select("ref", "mark").join(several, "mark").groupBy("ref")
             .agg(F.collect_set(F.struct("mark", "hot")).alias("marks")))
    return through_parquet(keyed.join(found, "ref").groupBy(name).agg(F.first("text").alias("text"), F.first("marks").alias("marks")), "candidates")


def marked_parts(texts: DataFrame, windows_of) -> DataFrame:
    """Parts of ``texts`` (key, start, text, marks) that windows with their marks cover: id, key, start, part (binary), kept in the shared folder.

    ``windows_of`` maps an Arrow column and the marks of each text to (text number, first byte, past byte) arrays.
    """
    def cut(batches):
        for batch in pieces(batches, "text", MARKED_BYTES):
            wanted = [[m["mark"] for m in marks] for marks in batch.column("marks").to_pylist()]
            owner, first, past = windows_of(batch.column("text"), wanted)
            data = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            own = pa.array(owner, pa.int64())
            starts = np.array(batch.column("start").to_pylist(), np.int64)
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key").take(own), "start": pa.array(starts[owner] + first if len(owner) else [], pa.int64()),
                "part": pa.array([data[o][a:b] for o, a, b in zip(owner, first, past)], pa.binary())})

    parts = small_batches(texts.select("key", "start", "text", "marks")).mapInArrow(cut, "key binary, start bigint, part binary")
    return through_parquet(parts.withColumn("id", F.monotonically_increasing_id()), "parts")
