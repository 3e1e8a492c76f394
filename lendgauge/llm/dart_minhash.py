"""Near-duplicate documents by DartMinHash.

A text is a weighted set: its shingles of five words, each weighing as often as it occurs. Every unit of an element's weight
is a region at which darts are thrown at hashed moments (a Poisson process) towards hashed coordinates; darts beyond the
element's weight don't hit. Of the darts that hit, each coordinate keeps the earliest. Two texts keep the same dart with the
probability of their weighted Jaccard similarity, and a text needs darts in proportion to the coordinates, not to coordinates
times elements. Bands of coordinates are join keys; pairs that meet are checked exactly; classes are connected components.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, new_place, removed
from .common import give_back, pieces, small_batches
from .rolling import Words, mixed, range_sums

SHINGLE = 5
SIMILARITY = 0.8
#: Texts that are 0.8 alike agree on a band with 0.8 ** 5 = 0.33, and miss all of 32 bands once in 300,000 times.
BANDS, BAND_ROWS = 32, 5
#: Texts that a task compares with each other.
SMALL_BUCKET = 512
#: Common elements of a text and the others of its set that are added up at a time.
HITS = 1 << 20
#: Counters that tell common elements from rare ones.
COUNTERS = 1 << 16



def shingle_sets(column, size=SHINGLE):
    """Weighted sets of a batch: text, element and weight, sorted by text. A text of fewer words is one element of all of them."""
    words = Words(column)
    hashes, at = words.windows(size)
    owner = words.owner[at]
    n_words = np.diff(words.begin)
    few = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(few):
        hashes = np.concatenate([hashes, mixed(range_sums(words.hash)(words.begin[few], words.begin[few + 1]), 7)])
        owner = np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return owner[first], hashes[first], np.diff(np.append(first, len(owner))).astype(float)


def _moments(regions, throw):
    """Waiting time before dart number ``throw`` of each region: exponential with mean 1."""
    bits = mixed(regions, 2 * throw + 11) >> np.uint64(11)
    return -np.log((bits.astype(float) + 0.5) * 2.0 ** -53)


def signatures(owner, element, weight, n, coordinates=BANDS * BAND_ROWS):
    """Earliest dart per text and coordinate (n x coordinates); 0 in rows of texts without elements.

    Weights may be any positive numbers: the last region of an element is cut, and darts above the cut don't hit.
    """
    out = np.zeros((n, coordinates), np.uint64)
    layers = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(owner)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    room = weight[at] - layer
    regions = mixed(element[at] + mixed(layer.astype(np.uint64), 5), 3)
    owner = owner[at]
    total = np.bincount(owner, np.minimum(room, 1), n)
    earliest = np.full(n * coordinates, np.inf)
    # So long a time fills all coordinates of nearly every text; the others get double the time.
    needed = coordinates * (np.log(coordinates) + 2)
    until = np.divide(needed, total, out=np.zeros(n), where=total > 0)
    open_texts = total > 0
    while open_texts.any():
        live = open_texts[owner]
        region, text, space, time = regions[live], owner[live], room[live], np.zeros(live.sum())
        earliest.reshape(n, -1)[open_texts] = np.inf
        throw, found = 0, []
        while len(region):
            time = time + _moments(region, throw)
            on = time <= until[text]
            region, text, space, time = region[on], text[on], space[on], time[on]
            dart = mixed(region, 2 * throw + 12)
            hit = (mixed(dart, 1) >> np.uint64(11)).astype(float) * 2.0 ** -53 < space
            found.append((text[hit] * coordinates + (mixed(dart[hit], 2) % np.uint64(coordinates)).astype(np.int64), time[hit], dart[hit]))
            throw += 1
        slot, time, dart = (np.concatenate(x) for x in zip(*found))
        # Latest first: what is written last stays.
        order = np.argsort(-time, kind="stable")
        out.reshape(-1)[slot[order]] = dart[order]
        earliest[slot[order]] = time[order]
        open_texts &= ~np.isfinite(earliest.reshape(n, -1)).all(axis=1)
        until = until * 2
    return out


def _band_rows(bands, rows):
    def sign(batches):
        for batch in pieces(batches, "text"):
            owner, element, weight = shingle_sets(batch.column("text"))
            n = batch.num_rows
            kept = signatures(owner, element, weight, n, bands * rows).reshape(n, bands, rows)
            hashes = np.zeros((n, bands), np.uint64)
            for i in range(rows):
                hashes = mixed(hashes ^ kept[:, :, i], i)
            hashes ^= mixed(np.arange(bands, dtype=np.uint64), 99)[None, :]
            has = np.bincount(owner, minlength=n) > 0
            offsets = np.concatenate(([0], np.cumsum(np.where(has, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"),
                "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[has].reshape(-1).view(np.int64)))})
    return sign


def classes(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (left, right): node, class (its smallest node).

    Large-star and small-star rounds: each node's neighbours are tied to the smallest of them, until nothing changes. A
    round's groups are only aggregated, never held.
    """
    def star(e, larger_only):
        # Large star ties larger neighbours to the smallest node; small star ties the node and its smaller neighbours.
        both = e.unionByName(e.select(F.col("right").alias("left"), F.col("left").alias("right")))
        near = both if larger_only else both.where("right < left")
        least = near.groupBy("left").agg(F.min("right").alias("m")).withColumn("m", F.least("m", "left"))
        tied = near.join(least, "left")
        if larger_only:
            return tied.where("right > left").select(F.col("right").alias("left"), F.col("m").alias("right")).where("left <> right").distinct()
        return (tied.select(F.col("right").alias("left"), F.col("m").alias("right"))
                .unionByName(least.select("left", F.col("m").alias("right"))).where("left <> right").distinct())

    spark = edges.sparkSession
    now, before, older = edges.select("left", "right").where("left <> right").distinct(), None, None
    while True:
        place = new_place(spark, "stars")
        star(star(now, True), False).write.parquet(place)
        now = spark.read.parquet(place)
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("left", "right").cast("bigint")), F.sum(F.xxhash64("left", "right") % 1000003)).first()
        # The round before has been read for the last time.
        if older:
            removed(spark, older)
        if state == before:
            break
        before, older = state, place
    return now.select(F.col("left").alias("node"), F.col("right").alias("class")).unionByName(
        now.select(F.col("right").alias("node"), F.col("right").alias("class")).distinct())


def sets_by_pieces(texts):
    """:func:`shingle_sets` of a pandas column of texts, one after the other as far as their bytes allow: 16 bytes an element are kept."""
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())})
    parts, done = [], 0
    for piece in pieces([batch], "text"):
        owner, element, weight = shingle_sets(piece.column("text"))
        parts.append(((owner + done).astype(np.uint32), element, weight.astype(np.float32)))
        done += piece.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts))


def _links_within(similarity):
    """Tasks' work on the texts of one set: all pairs are compared; links that join texts not joined before are given.

    Rows with ``label`` are joined already if it is the same; of rows with ``asks`` only those that ask are compared with all.
    """
    def compare(rows):
        n, keys = len(rows), rows["key"].tolist()
        owner, element, weight = sets_by_pieces(rows.pop("text"))
        total, begin = np.bincount(owner, weight, n), np.searchsorted(owner, np.arange(n + 1, dtype=np.uint32))
        order = np.argsort(element, kind="stable").astype(np.uint32)
        sorted_elements, found = element[order], []
        joined = np.unique(rows["label"], return_inverse=True)[1] if "label" in rows else np.arange(n)

        def compare_with_all(i):
            mine = slice(begin[i], begin[i + 1])
            first, past = (np.searchsorted(sorted_elements, element[mine], side) for side in ("left", "right"))
            sizes, own = past - first, weight[mine]
            shared = np.zeros(n)
            # Elements that most texts of a set share are many times many: so many at a time.
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // HITS, prepend=0, append=np.inf))
            for a, b in zip([0, *cuts[:-1]], cuts):
                part = sizes[a:b]
                hits = order[np.repeat(first[a:b] - (np.cumsum(part) - part), part) + np.arange(part.sum())]
                shared += np.bincount(owner[hits], np.minimum(np.repeat(own[a:b], part), weight[hits]), n)
            for j in np.flatnonzero(shared >= similarity * (total[i] + total - shared) - 1e-9):
                if joined[i] != joined[j]:
                    joined[joined == joined[j]] = joined[i]
                    found.append((keys[i], keys[j], float(shared[j] / (total[i] + total[j] - shared[j]))))
        if "asks" in rows:
            for i in np.flatnonzero(rows["asks"]):
                if (joined != joined[i]).any():
                    compare_with_all(i)
        else:
            # Texts of the largest class so far needn't be compared with each other, only the others with all.
            left = np.ones(n, bool)
            i = 0
            while True:
                compare_with_all(i)
                left[i] = False
                outside = np.flatnonzero(left & (joined != np.bincount(joined).argmax()))
                if not len(outside):
                    break
                i = outside[0]
        del owner, element, weight, order, sorted_elements
        give_back()
        return pd.DataFrame(found, columns=["left", "right", "similarity"])
    return compare


def _counters(texts: DataFrame):
    """How common elements are, by their remainder: the rounded logarithm of the number of texts, one byte each."""
    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in pieces(batches, "text"):
            total += np.bincount((shingle_sets(batch.column("text"))[1] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(held.astype(np.int32)), "n": pa.array(total[held])})

    out = np.zeros(COUNTERS)
    for row in small_batches(texts.select("text")).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[row.slot] = row.n
    return np.round(4 * np.log2(1 + out)).astype(np.uint8)


def _prefix_rows(counters, similarity):
    """Tasks' work: the rarest elements of each text, so many that two texts as alike as ``similarity`` have one in common.

    Both have at least that share of either's weight in common. In one order of all elements (any order is right, rare ones first
    meet seldom) the first common element is among the weight that is left, and one more unit, of either.
    """
    def keep(batches):
        for batch in pieces(batches, "text"):
            owner, element, weight = shingle_sets(batch.column("text"))
            order = np.lexsort((element, counters[(element % np.uint64(COUNTERS)).astype(np.int64)], owner))
            owner, element, weight = owner[order], element[order], weight[order]
            total = np.bincount(owner, weight, batch.num_rows)
            before = np.cumsum(weight) - weight
            before -= before[np.searchsorted(owner, owner)]
            kept = before < (total - np.ceil(similarity * total - 1e-9) + 1)[owner]
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key").take(pa.array(owner[kept])), "bucket": pa.array(element[kept].view(np.int64))})
    return keep


def _sized(members):
    """Members of buckets that hold more than one text, with the number of texts."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(sizes, "bucket")


LINK = "left binary, right binary, similarity double"


def _links_of_families(hot: DataFrame, texts: DataFrame, similarity, small):
    """Links between texts that have an element in common with very many, ``hot`` (key, bucket): all pairs, by blocks of texts.

    Texts whose hot elements hang together are a family. Its blocks are compared within first. Texts of the largest class so far
    needn't be compared with each other again; each other text is compared with all of the family, blocks with blocks.
    """
    # Tables of elements, families and their classes have a row for hundreds of texts.
    least = hot.groupBy("key").agg(F.min("bucket").alias("least"))
    parts = classes(hot.join(least, "key").select(F.col("least").alias("left"), F.col("bucket").alias("right")))
    members = checkpointed(least.join(F.broadcast(parts), F.col("least") == F.col("node"), "left").select(
        "key", F.coalesce("class", "least").alias("family")))
    cut = lambda n: F.ceil(F.col(n) / small)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n")).select("family", cut("n").alias("blocks"))
    placed = members.join(F.broadcast(sizes), "family").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    first = checkpointed(placed.join(texts, "key").select("family", "block", "key", "text").groupBy("family", "block")
                         .applyInPandas(_links_within(similarity), LINK))
    labelled = checkpointed(placed.join(classes(first), F.col("key") == F.col("node"), "left").select(
        "family", "block", "blocks", "key", F.coalesce("class", "key").alias("label")))
    largest = (labelled.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("family").agg(F.max(F.struct("n", "label"))["label"].alias("largest")))
    outside = checkpointed(labelled.join(F.broadcast(largest), "family").where("label <> largest").drop("largest"))
    asking = F.broadcast(outside.groupBy("family").agg(F.count(F.lit(1)).alias("n")).select("family", cut("n").alias("parts")))
    columns = ["family", "part", "block", "key", "label", "asks"]
    asks = (outside.join(asking, "family").withColumns({"part": F.pmod(F.xxhash64("key", F.lit(1)), "parts"), "asks": F.lit(True)})
            .drop("block").withColumn("block", every("blocks")).select(*columns))
    asked = labelled.join(asking, "family").withColumns({"part": every("parts"), "asks": F.lit(False)}).select(*columns)
    across = asks.unionByName(asked).join(texts, "key").groupBy("family", "part", "block").applyInPandas(_links_within(similarity), LINK)
    return first.unionByName(across)


def links(keyed: DataFrame, similarity=SIMILARITY, bands=BANDS, rows=BAND_ROWS, small=SMALL_BUCKET) -> DataFrame:
    """Checked links between different texts: left, right, similarity, enough of them to join all texts of a class.

    ``keyed`` has key (binary, the same for equal texts) and text. Texts of a bucket of at most ``small`` are compared with each
    other in a task; buckets with the same texts are one. Texts of larger buckets meet again by their rarest elements, which texts
    that are alike enough surely share and texts that merely share a passage don't. Where very many share one all the same, blocks
    of texts are compared with blocks. So all pairs of a bucket are compared, or in one class already, whatever its size, and no
    bucket is gathered whole.
    """
    spark, places = keyed.sparkSession, []

    def kept(df, name):
        places.append(new_place(spark, name))
        df.write.parquet(places[-1])
        return spark.read.parquet(places[-1])

    signed = small_batches(keyed.select("key", "text")).mapInArrow(_band_rows(bands, rows), "key binary, bands array<bigint>")
    # Signatures are the costly part: they are kept, one per text.
    signed = kept(signed.groupBy("key").agg(F.first("bands").alias("bands")), "signatures")
    members = signed.select("key", F.explode("bands").alias("bucket"))
    left = kept(_sized(members), "buckets").select("bucket", "key", "n")
    # Only texts that meet another are looked at again.
    met = left.groupBy("key").agg(F.max("n").alias("n"))
    texts = kept(keyed.select("key", "text").join(met, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("n").alias("n")), "texts")
    within, crowd, texts = left.where(F.col("n") <= small), texts.where(F.col("n") > small), texts.drop("n")
    done = None
    if not crowd.isEmpty():
        elements = small_batches(crowd.select("key", "text")).mapInArrow(
            _prefix_rows(_counters(crowd), similarity), "key binary, bucket bigint")
        met = kept(_sized(elements), "elements").select("bucket", "key", "n")
        within, hot = within.unionByName(met.where(F.col("n") <= small)), met.where(F.col("n") > small)
        done = _links_of_families(hot, texts, similarity, small) if not hot.isEmpty() else None
    sets = within.groupBy("bucket").agg(F.array_sort(F.collect_set("key")).alias("keys")).select("keys").distinct()
    dealt = sets.select(F.xxhash64("keys").alias("set"), F.explode("keys").alias("key")).join(texts, "key")
    near = dealt.groupBy("set").applyInPandas(_links_within(similarity), LINK)
    found = checkpointed((done.unionByName(near) if done else near).distinct())
    # Links need neither texts nor buckets any more.
    for place in places:
        removed(spark, place)
    return found


def group(docs: DataFrame, id="doc_id", text="text", similarity=SIMILARITY, bands=BANDS, rows=BAND_ROWS,
          into=("class_id", "is_first")) -> DataFrame:
    """``docs`` with ``class_id``, the smallest id among its near-duplicates, and ``is_first``, true for one row of each class.

    Equal texts are one class at once and meet others as one text. Texts without words (null, empty, white space) have nothing
    to compare: each of their rows is a class of its own, and first. A class whose ids are all null has a null class_id. Equal
    rows stay, one of them first. Columns of ``docs`` that have the names in ``into`` are replaced.
    """
    docs = docs.drop(*into)
    keyed = docs.withColumns({
        "__key": F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text))), "__row": F.monotonically_increasing_id()})
    known = keyed.where("__key is not null")
    found = classes(links(known.select(F.col("__key").alias("key"), F.col(text).alias("text")), similarity, bands, rows))
    own = known.groupBy(F.col("__key").alias("key")).agg(F.min(F.struct(F.col(id).isNull(), F.col(id).alias("id"), F.col("__row").alias("row"))).alias("first"))
    labelled = own.join(found, own.key == found.node, "left").select("key", "first", F.coalesce("class", "key").alias("class"))
    first = labelled.groupBy("class").agg(F.min("first").alias("f")).select("class", F.col("f.id").alias("__class"), F.col("f.row").alias("__first"))
    members = labelled.select("key", "class").join(first, "class").select(F.col("key").alias("__key"), "__class", "__first")
    grouped = known.join(members, "__key").withColumns({into[0]: F.col("__class"), into[1]: F.col("__row") == F.col("__first")})
    alone = keyed.where("__key is null").withColumns({into[0]: F.col(id), into[1]: F.lit(True)})
    names = [*docs.columns, *into]
    return grouped.select(*names).unionByName(alone.select(*names))
