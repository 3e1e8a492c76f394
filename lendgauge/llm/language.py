"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from the vectors of its letters, permuted by their
place in it, by multiplication; a text bundles (sums) the vectors of its trigrams, a language those of its texts. A text
has the language whose prototype has the largest cosine with it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

DIMENSIONS = 512
SEED = 20_240_601
#: Letters and the word border, ids below 2**21, so that three of them fit a 64-bit number.
BORDER = 32
#: Characters of a batch whose trigrams are counted at a time: bounds the memory of very long texts.
SLICE = 1 << 18
#: Trigrams bound at a time.
BOUND_AT_ONCE = 4096
#: Bits that stand for learned trigrams: few enough to be sent to every task, so many that a strange trigram seldom hits one.
KNOWN_BITS = 1 << 24
#: A trigram is learned if at least this share of the texts of a language have it.
LEARNED_FROM = 0.05
#: A text has something in common with the learned languages from this share of learned trigrams on.
KNOWN_SHARE = 0.1
UNKNOWN = "und"

_letters = None


def _is_letter():
    """Flag per code point, made once per Python worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vectors(letters, dimensions=DIMENSIONS, seed=SEED):
    """Random vector of +1 and -1 per code point: bits of a mixed counter, the same in every task."""
    words = dimensions // 64
    counter = (np.asarray(letters, np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)) + np.uint64(seed)
    z = (counter + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    bits = np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def trigram_codes(text):
    """Codes of the trigrams of letters, runs of anything else counting as one border; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _is_letter()[points]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    symbols = np.where(is_letter, points, BORDER)
    keep = np.ones(len(symbols), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    s = np.concatenate(([BORDER], symbols[keep], [BORDER])).astype(np.uint64)
    return (s[:-2] << np.uint64(42)) | (s[1:-1] << np.uint64(21)) | s[2:]


def trigram_vectors(codes, dimensions=DIMENSIONS):
    """One bound vector per code."""
    mask = np.uint64((1 << 21) - 1)
    places = [(codes >> np.uint64(42)) & mask, (codes >> np.uint64(21)) & mask, codes & mask]
    letters, ids = np.unique(np.concatenate(places), return_inverse=True)
    table = letter_vectors(letters, dimensions)
    first, second, third = np.split(ids, 3)
    return np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]


def bundles(texts, groups, n_groups, dimensions=DIMENSIONS):
    """Sum of the trigram vectors per group of texts, and the number of trigrams of each group."""
    out = np.zeros((n_groups, dimensions), np.float32)
    sizes = np.zeros(n_groups, np.int64)
    held, owners, held_size = [], [], 0

    def add():
        codes, owner = np.concatenate(held), np.repeat([g for g, _ in owners], [n for _, n in owners])
        found, ids = np.unique(codes, return_inverse=True)
        pairs, counts = np.unique(owner.astype(np.int64) * len(found) + ids, return_counts=True)
        rows, columns = pairs // len(found), pairs % len(found)
        present, rows = np.unique(rows, return_inverse=True)
        for start in range(0, len(found), BOUND_AT_ONCE):
            stop = min(start + BOUND_AT_ONCE, len(found))
            here = (columns >= start) & (columns < stop)
            dense = np.zeros((len(present), stop - start), np.float32)
            dense[rows[here], columns[here] - start] = counts[here]
            out[present] += dense @ trigram_vectors(found[start:stop], dimensions).astype(np.float32)

    for text, group in zip(texts, groups):
        codes = trigram_codes(text) if text else np.empty(0, np.uint64)
        sizes[group] += len(codes)
        for start in range(0, len(codes), SLICE):
            part = codes[start:start + SLICE]
            held.append(part)
            owners.append((group, len(part)))
            held_size += len(part)
            if held_size >= SLICE:
                add()
                held, owners, held_size = [], [], 0
    if held:
        add()
    return out, sizes


def learn(docs: DataFrame, text="text", lang="lang", dimensions=DIMENSIONS):
    """Prototype per language: ``{language: unit vector}``.

    Every row with a text and a language counts. Tasks bundle their own rows, so that a shuffle carries one vector per
    task and language; the driver gets one vector per language. Rows whose text has no letter add nothing.
    """
    def bundle(batches):
        totals = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            vectors, sizes = bundles(batch.column(0).to_pylist(), [names.index(x) for x in langs], len(names), dimensions)
            for name, vector, size in zip(names, vectors.astype(np.float64), sizes):
                if size:
                    totals[name] = totals.get(name, 0) + vector
        if totals:
            flat = np.concatenate(list(totals.values()))
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(np.repeat(list(totals), dimensions), pa.string()),
                "place": pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(totals))), "value": pa.array(flat)})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    sums = (small_batches(rows).mapInArrow(bundle, "lang string, place int, value double")
            .groupBy("lang", "place").agg(F.sum("value").alias("value")).collect())
    prototypes = {}
    for row in sums:
        prototypes.setdefault(row.lang, np.zeros(dimensions))[row.place] = row.value
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(prototypes.items())}


def identify(docs: DataFrame, prototypes, text="text", into=("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its cosine, cut to 0 to 1.

    Null and empty texts, texts without a letter, and all texts when nothing was learned get ``und`` and 0. Among equal
    cosines the first language in code point order wins. Columns of ``docs`` that have the names in ``into`` are replaced.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    kept = [c for c in docs.columns if c not in into]
    carried = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(into[0]), F.lit(0.0).alias(into[1])).schema

    def predict(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            vectors, sizes = bundles(texts, range(len(texts)), len(texts), matrix.shape[1])
            norms = np.linalg.norm(vectors, axis=1)
            known = (sizes > 0) & (norms > 0) & bool(names)
            cosines = (vectors @ matrix.T) / np.where(norms > 0, norms, 1)[:, None] if names else np.zeros((len(texts), 1))
            best = cosines.argmax(axis=1) if len(texts) else np.zeros(0, int)
            langs = [names[b] if k else UNKNOWN for b, k in zip(best, known)]
            scores = np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)],
                                             names=[*kept, *into])

    return small_batches(carried).mapInArrow(predict, schema)


def _slots(codes):
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (KNOWN_BITS.bit_length() - 1))).astype(np.int64)


def known_trigrams(docs: DataFrame, text="text", lang="lang", learned_from=LEARNED_FROM):
    """Flag per trigram slot: whether it is in a share of ``learned_from`` or more of the texts of some language.

    Shares of texts don't change with their number, so a few odd texts of a language teach nothing however large the corpus is. A
    row counts as often as it is there; rows without a language count for nothing. The flags are of fixed size.
    """
    def count(batches):
        held, waiting = {}, {}

        def add(name):
            slots, times = held.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            new, of_new = np.unique(np.concatenate(waiting.pop(name)), return_counts=True)
            both, where = np.unique(np.concatenate([slots, new]), return_inverse=True)
            held[name] = both, np.bincount(where, np.concatenate([times, of_new]), len(both)).astype(np.int64)

        for batch in batches:
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.setdefault(name, []).append(np.unique(_slots(trigram_codes(value))))
            for name in [n for n, parts in waiting.items() if sum(map(len, parts)) >= SLICE]:
                add(name)
        for name in list(waiting):
            add(name)
        for name, (slots, times) in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(slots), pa.string()), "slot": pa.array(slots), "n": pa.array(times)})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    sizes = rows.groupBy("lang").agg(F.count("*").alias("texts"))
    often = (small_batches(rows).mapInArrow(count, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
             .join(sizes, "lang").where(F.col("n") >= learned_from * F.col("texts")))
    found = often.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("bits")).collect()
    words = np.zeros(KNOWN_BITS // 64, np.int64)
    words[[r.word for r in found]] = [r.bits for r in found]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def with_known_share(docs: DataFrame, flags, text="text", into="known") -> DataFrame:
    """``docs`` with the share of a text's trigrams that are learned, 0 for a text without a letter."""
    names, bits = docs.columns, np.packbits(flags)
    carried = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))

    def share(batches):
        for batch in batches:
            shares = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                at = _slots(trigram_codes(value)) if value else np.zeros(0, np.int64)
                shares.append(float((bits[at >> 3] >> (7 - (at & 7)) & 1).mean()) if len(at) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shares, pa.float64())], names=[*names, into])

    return small_batches(carried).mapInArrow(share, docs.withColumn(into, F.lit(0.0)).schema)


def held_out(doc_id):
    """Column: whether a document is kept from learning. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2
