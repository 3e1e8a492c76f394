"""Byte-level BPE encoding of overlapping chunks, and decoding.

A long text is cut into chunks of ``CHUNK`` characters that overlap the next by ``OVERLAP``. Each chunk finds its
pre-tokens alone. Where two neighbours have a pre-token border in common inside their overlap they agree from there on,
so the left one hands over there; the piece of text between two such places is then encoded alone. Neighbours without a
common border are encoded as one piece. Texts within one chunk need no stitching and never leave their task.
"""

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

CHUNK = 1 << 15
OVERLAP = 1 << 9

_encodings = {}


def encoding(path, pattern):
    """The tokenizer of a rank file, read once per Python worker."""
    import tiktoken

    if (path, pattern) not in _encodings:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def borders(text, pattern):
    """Places in ``text`` where a pre-token starts with white space after another character.

    No pre-token goes on from another character to white space, so such a place is a border wherever the reading began,
    and a cut there changes nothing: how a run of white space is split depends only on what follows it.
    """
    return [m.start() for m in regex.finditer(pattern, text)
            if m.start() and text[m.start()].isspace() and not text[m.start() - 1].isspace()]


def _chunk_borders(pattern, overlap, chunk):
    def find(batches):
        for batch in batches:
            found = [borders(part, pattern) for part in batch.column("part").to_pylist()]
            heads, tails = [[b for b in x if b < overlap] for x in found], [[b - chunk for b in x if b >= chunk] for x in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "head", "tail"])
    return find


def _encoded(path, pattern, digest):
    """Tasks' work: ids of each text in the last column, or the digests that stand for them."""
    def encode(batches):
        bpe = encoding(path, pattern)
        names = [str(i) for i in range(bpe.n_vocab)] if digest else None
        for batch in batches:
            ids = [bpe.encode_ordinary(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            rest = batch.columns[:-1]
            if digest:
                texts = (" ".join([names[i] for i in row]) for row in ids)
                columns = [pa.array([len(row) for row in ids], pa.int64()),
                           pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                           pa.array([hashlib.sha256(bpe.decode_bytes(row)).hexdigest() for row in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*rest, *columns], names=[*batch.schema.names[:-1], *DIGESTS])
            else:
                yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.list_(pa.int32()))],
                                                 names=[*batch.schema.names[:-1], "ids"])
    return encode


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def _by_length(docs, keep, text, chunk):
    """Rows with what is kept packed in one column, whatever its names, and of those the texts within one chunk and the others."""
    rows = docs.select(F.struct(*keep).alias("__keep"), F.col(text).alias("__text"))
    return rows, rows.where(F.coalesce(F.length("__text"), F.lit(0)) <= chunk), rows.where(F.length("__text") > chunk)


def _long_ids(docs, path, pattern, chunk, overlap):
    """``__keep`` and ids for texts of more than one chunk: chunks, hand-over places, pieces, ids in order."""
    # The row's number tells equal rows apart while their pieces are apart.
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    length = F.length("__text")
    parts = (rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.floor((length - 1) / chunk).cast("int"))))
             .select("__keep", "__row", "__i", F.substring(F.col("__text"), F.col("__i") * chunk + 1, F.lit(chunk + overlap)).alias("part"))
             # Chunks of a text go to different tasks here.
             .repartition(F.col("__row"), F.col("__i")))
    schema = parts.withColumns({"head": F.array().cast("array<int>"), "tail": F.array().cast("array<int>")}).schema
    found = small_batches(parts).mapInArrow(_chunk_borders(pattern, overlap, chunk), schema)
    order = Window.partitionBy("__row").orderBy("__i")
    common = F.array_intersect(F.col("head"), F.lag("tail").over(order))
    placed = found.withColumn("start", F.when(F.col("__i") == 0, 0).otherwise(F.array_min(common)))
    # A chunk that never agrees with its left neighbour joins that one's piece.
    piece = F.sum(F.when(F.col("start").isNotNull(), 1).otherwise(0)).over(order)
    after = F.lead("start").over(order)
    last = F.lead("__i").over(order).isNull()
    own = (placed.withColumn("__piece", piece)
           .withColumn("__end", F.when(last, F.length("part")).otherwise(F.coalesce(after + chunk, F.lit(chunk))))
           .withColumn("own", F.expr("substring(part, coalesce(start, 0) + 1, __end - coalesce(start, 0))")))
    # Pieces are whole again once the chunks that share one are joined; nearly always a piece is one chunk.
    whole = own.groupBy("__row", "__piece").agg(
        F.first("__keep").alias("__keep"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "own"))), lambda x: x["own"]), "").alias("own"))
    encoded = small_batches(whole.select("__keep", "__row", "__piece", "own")).mapInArrow(
        _encoded(path, pattern, False),
        whole.select("__keep", "__row", "__piece").withColumn("ids", F.array().cast("array<int>")).schema)
    ordered = F.array_sort(F.collect_list(F.struct("__piece", "ids")))
    return encoded.groupBy("__row").agg(F.first("__keep").alias("__keep"),
                                        F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids")).drop("__row")


def encode(docs: DataFrame, path, pattern, keep=("doc_id",), text="text", chunk=CHUNK, overlap=OVERLAP) -> DataFrame:
    """Columns ``keep`` and ``ids array<int>`` of every row, as one pass over its whole text would give.

    A null or empty text has no ids. Equal rows stay separate rows. ``docs`` may have further columns of any name.
    """
    docs, small, large = _by_length(docs, keep, text, chunk)
    schema = docs.select("__keep", F.array().cast("array<int>").alias("ids")).schema
    short = small_batches(small).mapInArrow(_encoded(path, pattern, False), schema)
    return short.unionByName(_long_ids(large, path, pattern, chunk, overlap)).select("__keep.*", "ids")


def decode(rows: DataFrame, path, pattern, ids="ids", into="decoded") -> DataFrame:
    """``rows`` with the bytes of their ids joined; ids cut inside a character give bytes that are no text. Null: null."""
    kept = [c for c in rows.columns if c != into]
    carried = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("__ids"))

    def join(batches):
        bpe = encoding(path, pattern)
        for batch in batches:
            out = [None if x is None else bpe.decode_bytes(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*kept, into])

    return small_batches(carried).mapInArrow(join, carried.drop("__ids").withColumn(into, F.lit(b"")).schema)


def digests(docs: DataFrame, path, pattern, keep=("doc_id",), text="text", chunk=CHUNK, overlap=OVERLAP) -> DataFrame:
    """Columns ``keep``, the number of ids, the digest of the ids and that of the bytes they decode to.

    The same work as ``encode`` and ``decode``; texts within one chunk are digested where they are encoded, so their ids
    need not be sent back.
    """
    docs, small, large = _by_length(docs, keep, text, chunk)
    fields = docs.select("__keep", F.lit(0).cast("bigint").alias(DIGESTS[0]), F.lit("").alias(DIGESTS[1]),
                         F.lit("").alias(DIGESTS[2])).schema
    short = small_batches(small).mapInArrow(_encoded(path, pattern, True), fields)
    long = decode(_long_ids(large, path, pattern, chunk, overlap), path, pattern).select(
        "__keep", F.size("ids").cast("bigint").alias(DIGESTS[0]), F.sha2(F.array_join("ids", " "), 256).alias(DIGESTS[1]),
        F.sha2("decoded", 256).alias(DIGESTS[2]))
    return short.unionByName(long).select("__keep.*", *DIGESTS)
