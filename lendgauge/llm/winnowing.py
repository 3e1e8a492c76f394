"""Document fingerprints by winnowing.

A gram is 16 characters in a row, a window 32 grams in a row. Of every window the gram with the smallest hash is selected, the
rightmost one of equal ones. Texts that share 47 characters in a row share the gram selected there. Selected grams keep their
places. Only DataFrame functions are used.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 16, 32
#: Characters of a block; a block's grams are numbered in 13 bits.
BLOCK, PLACE_BITS = 4096, 13
#: Ranges of ids that neighbours are looked up in.
BUCKETS = 1024


def guarantee(gram=GRAM, window=WINDOW):
    """Characters that two texts must share in a row to be sure to share a selected gram."""
    return gram + window - 1


def _let(value, body):
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(gram, place):
    """Hash and place in one number: smaller for smaller hashes, and among equal ones for places further right."""
    last = (1 << PLACE_BITS) - 1
    return F.shiftleft(F.xxhash64(gram), PLACE_BITS).bitwiseOR(F.lit(last).cast("bigint") - place)


def _smallest(numbers, window):
    """Smallest number of each window, by doubling the number of grams that are looked at."""
    def double(values, reach):
        step = min(reach, window - reach)
        if not step:
            return values
        paired = F.zip_with(values, F.slice(values, 1 + step, F.greatest(F.size(values) - step, F.lit(0))), lambda a, b: F.least(a, b))
        return _let(paired, lambda x: double(x, reach + step))
    # The last entries saw fewer grams than a window has.
    return F.slice(double(numbers, 1), F.lit(1), F.greatest(F.size(numbers) - (window - 1), F.lit(0)))


def selected(text, gram=GRAM, window=WINDOW):
    """Column: selected grams of a text as array<struct<place int, hash bigint>> by place.

    Null and empty texts have none. A text of fewer characters than a gram is one gram; one of fewer grams than a window is one
    window.
    """
    pattern = r"(?s)(?!\p{Cs})(?=(.{%d}))" % gram
    last = (1 << PLACE_BITS) - 1

    def of_block(block, i):
        numbers = F.transform(F.regexp_extract_all(block, F.lit(pattern), F.lit(1)), _numbered)
        own = _let(numbers, lambda n: F.when(F.size(n) >= window, F.array_distinct(_smallest(n, window)))
                   .when((F.size(n) > 0) & (i == 0), F.array(F.array_min(n))).otherwise(F.array().cast("array<bigint>")))
        return F.transform(own, lambda n: F.struct(
            (i * BLOCK + last - n.bitwiseAND(F.lit(last).cast("bigint"))).cast("int").alias("place"), F.shiftright(n, PLACE_BITS).alias("hash")))

    n = F.length(text)
    places = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    blocks = F.transform(places, lambda i: of_block(F.substring(text, i * BLOCK + 1, F.lit(BLOCK + guarantee(gram, window) - 1)), i))
    # A gram at a border of blocks may be selected from both sides.
    once = _let(F.flatten(blocks), lambda g: F.filter(g, lambda x, i: (i == 0) | (F.get(g, i - 1)["place"] != x["place"])))
    whole = F.array(F.struct(F.lit(0).alias("place"), F.shiftright(_numbered(text, F.lit(0)), PLACE_BITS).alias("hash")))
    return F.when(n >= gram, once).when(n > 0, whole).otherwise(F.array().cast("array<struct<place: int, hash: bigint>>"))


def hashes(grams):
    """Column: the different hashes of selected grams."""
    return F.array_distinct(F.transform(grams, lambda g: g["hash"]))


def spliced(own, cut, other, taken, text, gram=GRAM, window=WINDOW):
    """Column: different hashes of the selected grams of a text made of two beginnings.

    ``text`` is the first ``cut`` characters of one text, whose selected grams are ``own``, and the first ``taken`` of another
    with ``other``. A gram is selected by windows near it only: grams that far from the places where the parts end are those
    of the parts, and the surroundings of these places are looked at anew. The same as ``hashes(selected(text))``.
    """
    reach = guarantee(gram, window)
    start = F.greatest(cut - 2 * reach, F.lit(0))
    joint = F.substring(text, start + 1, cut + 2 * reach - start)
    end = F.substring(text, F.greatest(cut + taken - 2 * reach, F.lit(0)) + 1, F.lit(2 * reach))
    part = lambda grams, limit: F.transform(F.filter(grams, lambda g: g["place"] <= limit - reach), lambda g: g["hash"])
    new = lambda t: F.transform(selected(t, gram, window), lambda g: g["hash"])
    return F.array_distinct(F.concat(part(own, cut), new(joint), part(other, taken), new(end)))


def digest(different):
    """Column: a string that stands for a set of hashes."""
    return F.sha2(F.array_join(F.array_sort(different), ","), 256)


def likeness(a, b):
    """Column: share of the hashes of two sets that are in both; 1 for two empty sets."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, 1.0).otherwise(shared / total)


def with_next(docs: DataFrame, add, id="doc_id", text="text", buckets=BUCKETS) -> DataFrame:
    """``docs`` with what ``add`` adds to them, and the text and the additions of the document with the next smaller id.

    The last document's next is the first. Ids that are null come last; rows of one id are ordered by text. New columns are
    ``next_text`` and ``next_`` before the names of ``add`` (name: column of the text). Texts are shuffled once, into ranges of ids;
    the first document of each range also goes to the range before it.
    """
    probabilities = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx(id, F.lit(probabilities), F.lit(10 * buckets)).alias("cuts")).first()["cuts"]
    cuts = sorted(set(found or []), reverse=True)
    # Ranges in falling order of id; their number is fixed, so the table of their first ids is small at any size.
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c > F.col(id).cast("bigint")))
    bucket = F.when(F.col(id).isNull(), F.lit(len(cuts) + 1)).otherwise(place)
    placed = docs.withColumn("__bucket", bucket).withColumn("__guest", F.lit(0))
    firsts = placed.groupBy("__bucket").agg(F.max(id).alias("__first"))
    around = Window.orderBy("__bucket")
    whole = Window.partitionBy()
    before = F.coalesce(F.lag("__bucket").over(around), F.max("__bucket").over(whole))
    guests_of = firsts.withColumn("__before", before)
    guests = (placed.join(F.broadcast(guests_of.withColumnRenamed("__bucket", "__b")),
                          (F.col("__bucket") == F.col("__b")) & F.col(id).eqNullSafe(F.col("__first")))
              .withColumn("__bucket", F.col("__before")).withColumn("__guest", F.lit(1)).select(*placed.columns))
    order = [F.col("__guest"), F.col(id).desc_nulls_last(), F.col(text).desc()]
    ranged = placed.unionByName(guests).repartition("__bucket").sortWithinPartitions("__bucket", *order)
    window = Window.partitionBy("__bucket").orderBy(*order)
    added = ranged.withColumns(add)
    return (added.withColumns({f"next_{c}": F.lead(c).over(window) for c in (text, *add)})
            .where("__guest = 0").drop("__bucket", "__guest"))
