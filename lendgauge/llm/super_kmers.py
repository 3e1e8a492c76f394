"""Repeated runs of words by super-k-mer partitioning.

A window of 35 words has the smallest hash of its 8-word grams as its minimiser. Consecutive windows that share a minimiser
travel as one packed string to the minimiser's bucket; there the windows are sorted as strings, so that equal ones meet and
are counted exactly. Windows whose minimiser stands at one place of the whole corpus have no equal and don't travel.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches
from .mixing import word_count
from .repeats import HOT, candidates, per_text, text_key, window_marks
from .rolling import Words, mixed, range_sums

WINDOW = 35
GRAM = 8


def _minimisers(words, window, gram):
    """Minimiser of each window of a batch, the place of its first word, and the gram of each place with the text it is in."""
    n = len(words.hash)
    places = np.arange(max(n - gram + 1, 0))
    grams = mixed(range_sums(words.hash)(places, places + gram), 1)
    inside = np.zeros(n, bool)
    starts = np.arange(max(n - window + 1, 0))
    inside[starts] = words.owner[starts] == words.owner[starts + window - 1] if len(starts) else False
    marks, at = window_marks(grams, inside, window - gram + 1)
    whole = words.owner[places] == words.owner[places + gram - 1] if len(places) else np.zeros(0, bool)
    return marks, at, words.owner[places[whole]] if len(places) else places, grams[whole]


def _marks_of(window, gram):
    def marks(column):
        words = Words(column)
        found, at, owner, grams = _minimisers(words, window, gram)
        return per_text(words.owner[at], found, owner, grams)
    return marks


def super_kmers(texts: DataFrame, window=WINDOW, gram=GRAM) -> DataFrame:
    """Packed strings of the windows whose minimiser is among the text's ``marks``: key, minimiser, hot, start (word), n (windows), packed."""
    def pack(batches):
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"))
            found, at, _, _ = _minimisers(words, window, gram)
            owner = words.owner[at]
            new = np.ones(len(at), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(at)))
            wanted = [{m["mark"]: m["hot"] for m in marks} for marks in batch.column("marks").to_pylist()]
            minimisers = found[first].view(np.int64).tolist()
            rows, text = [], words.data.tobytes()
            for i, minimiser, o in zip(range(len(first)), minimisers, owner[first].tolist()):
                if minimiser in wanted[o]:
                    a = int(at[first[i]])
                    packed = b" ".join([text[words.first[w]:words.past[w]] for w in range(a, a + int(n[i]) + window - 1)])
                    rows.append((o, minimiser, wanted[o][minimiser], a - int(words.begin[o]), int(n[i]), packed))
            o, minimiser, hot, start, number, packed = zip(*rows) if rows else ([],) * 6
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key").take(pa.array(o, pa.int64())), "minimiser": pa.array(minimiser, pa.int64()),
                "hot": pa.array(hot, pa.bool_()), "start": pa.array(start, pa.int32()), "n": pa.array(number, pa.int32()),
                "packed": pa.array(packed, pa.binary())})

    return small_batches(texts).mapInArrow(pack, "key binary, minimiser bigint, hot boolean, start int, n int, packed binary")


def _windows(packed, n, window):
    """The windows of a packed string."""
    ends = [i for i, b in enumerate(packed) if b == 32]
    first, past = [0, *[e + 1 for e in ends]], [*ends, len(packed)]
    return [packed[first[i]:past[i + window - 1]] for i in range(n)]


def _count(window):
    """Tasks' work on rows sorted by minimiser: runs of windows that have an equal, as (key, start, past) in windows."""
    def finish(bucket):
        found = sorted((w, r, i) for r, (_, _, n, packed) in enumerate(bucket) for i, w in enumerate(_windows(packed, n, window)))
        again = set()
        for (w, r, i), (w2, r2, i2) in zip(found, found[1:]):
            if w == w2:
                again |= {(r, i), (r2, i2)}
        runs = []
        for r, i in sorted(again):
            key, start = bucket[r][:2]
            if runs and runs[-1][0] is key and runs[-1][2] == start + i:
                runs[-1][2] += 1
            else:
                runs.append([key, start + i, start + i + 1])
        return runs

    def count(batches):
        bucket, now = [], None
        for batch in batches:
            runs = []
            for minimiser, *row in zip(*[batch.column(c).to_pylist() for c in ("minimiser", "key", "start", "n", "packed")]):
                if minimiser != now:
                    runs += finish(bucket)
                    bucket, now = [], minimiser
                bucket.append(row)
            yield as_batch(runs)
        yield as_batch(finish(bucket))

    def as_batch(runs):
        key, start, past = zip(*runs) if runs else ([],) * 3
        return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.binary()), "start": pa.array(start, pa.int32()), "past": pa.array(past, pa.int32())})
    return count


def repeated(texts: DataFrame, window=WINDOW, gram=GRAM) -> DataFrame:
    """Runs of windows that start anywhere else too: key, start, past (numbers of their first words, ``past`` exclusive).

    ``texts`` as ``candidates`` gives them. A bucket of a minimiser that isn't hot has a bounded number of strings. Of a hot one,
    equal strings are summed first; the windows of the different strings are counted under their own words, with the number of
    places of their string, and what repeats goes back to the places string by string.
    """
    packed = super_kmers(texts, window, gram)
    cold = packed.where("NOT hot").select("minimiser", "key", "start", "n", "packed").repartition("minimiser").sortWithinPartitions("minimiser")
    runs = small_batches(cold).mapInArrow(_count(window), "key binary, start int, past int")

    def single(batches):
        for batch in batches:
            rows = []
            for string, n, packed_words, places in zip(*[batch.column(c).to_pylist() for c in ("string", "n", "packed", "places")]):
                at = {}
                for i, w in enumerate(_windows(packed_words, n, window)):
                    at.setdefault(w, []).append(i)
                rows += [(string, w, i, len(i) * places) for w, i in at.items()]
            string, words, at, places = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_pydict({"string": pa.array(string, pa.binary()), "words": pa.array(words, pa.binary()),
                                              "at": pa.array(at, pa.list_(pa.int32())), "places": pa.array(places, pa.int64())})

    hot = packed.where("hot").withColumn("string", F.unhex(F.md5("packed")))
    strings = hot.groupBy("string").agg(F.first("packed").alias("packed"), F.first("n").alias("n"), F.count(F.lit(1)).alias("places"))
    alone = small_batches(strings.select("string", "n", "packed", "places")).mapInArrow(
        single, "string binary, words binary, at array<int>, places bigint")
    equal = alone.groupBy("words").agg(F.sum("places").alias("c")).where("c > 1").select("words")
    again = alone.join(equal, "words").groupBy("string").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    # Neighbouring windows of a string make one run.
    ends = F.filter("at", lambda x, i: F.coalesce(F.get("at", i + 1) != x + 1, F.lit(True)))
    begins = F.filter("at", lambda x, i: F.coalesce(F.get("at", i - 1) != x - 1, F.lit(True)) | (i == 0))
    ranges = again.select("string", F.arrays_zip(begins.alias("a"), ends.alias("b")).alias("ranges"))
    back = hot.select("string", "key", "start").join(ranges, "string").select("key", "start", F.explode("ranges").alias("r"))
    return runs.unionByName(back.select("key", (F.col("start") + F.col("r.a")).alias("start"), (F.col("start") + F.col("r.b") + 1).alias("past")))


def _cut(window):
    """Tasks' work: text without the words that repeated windows cover, white space between kept words as it was."""
    def cut(batches):
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"))
            kept, removed = [], []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                a, b = words.begin[i], words.begin[i + 1]
                change = np.zeros(b - a + 1, np.int64)
                for run in runs:
                    change[run["start"]] += 1
                    change[min(run["past"] + window - 1, b - a)] -= 1
                stay = np.cumsum(change[:-1]) == 0
                removed.append(int((~stay).sum()))
                text, first, past = words.data[words.starts[i]:words.starts[i + 1]].tobytes(), words.first[a:b] - words.starts[i], words.past[a:b] - words.starts[i]
                parts, at = [], 0
                edge = np.flatnonzero(np.diff(np.concatenate(([True], stay, [True])).astype(np.int8)))
                for opened, closed in zip(edge[::2], edge[1::2]):
                    # A removed run goes with the white space after it.
                    parts.append(text[at:first[opened]])
                    at = first[closed] if closed < b - a else past[closed - 1]
                kept.append(b"".join([*parts, text[at:]]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})
    return cut


def verdicts(docs: DataFrame, text="text", window=WINDOW, gram=GRAM, hot=HOT) -> DataFrame:
    """Small table of the texts that lose words: key, n_removed, kept; one row per different text.

    A text that occurs in several rows and has a whole window loses all its words.
    """
    texts = candidates(docs, _marks_of(window, gram), text, hot)
    ranges = repeated(texts, window, gram).groupBy("key").agg(F.collect_list(F.struct("start", "past")).alias("runs"))
    cut = small_batches(texts.select("key", "text").join(ranges, "key")).mapInArrow(_cut(window), "key binary, n_removed bigint, kept string")
    copies = (docs.select(text_key(F.col(text)).alias("key"), word_count(F.col(text)).alias("n_removed"))
              .groupBy("key").agg(F.max("n_removed").alias("n_removed"), F.count(F.lit(1)).alias("c"))
              .where((F.col("c") > 1) & (F.col("n_removed") >= window)).select("key", "n_removed", F.lit("").alias("kept")))
    return cut.unionByName(copies).groupBy("key").agg(F.max_by("kept", "n_removed").alias("kept"), F.max("n_removed").alias("n_removed"))


def strip(docs: DataFrame, text="text", window=WINDOW, gram=GRAM, hot=HOT) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``; texts that lose nothing stay as they are, null too.

    Every row stays, also one that loses all its words. ``docs`` may have columns of any name but ``__key``.
    """
    found = verdicts(docs, text, window, gram, hot).select(F.col("key").alias("__key"), F.col("kept").alias("__kept"))
    return (docs.withColumn("__key", text_key(F.col(text))).join(found, "__key", "left")
            .select(*[F.coalesce("__kept", F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]))
