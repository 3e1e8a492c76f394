"""Repeated byte strings by a suffix array of a difference-cover sample.

Texts are byte strings; only their parts that can hold a repeated string of 200 bytes go on (``repeats`` finds them by marks). Places of
a part that are in a difference cover modulo 133 are its sample: 12 of 133, and for any two places some shift below 133 leads both to
sampled ones. So two equal strings of 200 bytes meet at a pair of sampled suffixes that share at least 68 bytes, with what is left of
200 bytes before and after them. Sampled suffixes are dealt out by a hash of their first 68 bytes. Those with equal surroundings (128
bits of all bytes that such strings could cover) are one row and have found each other; of the others the bytes travel. There the suffixes of a class
are sorted, and so are the reversed bytes before them. A string that starts ``s`` bytes before its sampled place equals another if it
is in one run of common prefixes of ``200 - s`` bytes with it, and in one run of ``s`` common bytes before.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_place, removed
from .common import PIECE_BYTES, give_back, pieces, small_batches
from .repeats import HOT, MARKED_BYTES, candidates, marked_parts, per_text, text_key, window_marks
from .rolling import joined, mixed, range_sums

LENGTH = 200
#: Bytes of the grams that mark windows, from coarse to fine. Long grams rule out more but give more marks; what finer ones than
#: this would rule out costs less as sampled places without a class.
GRAMS = (64,)
#: Perfect difference sets: every difference but 0 occurs once modulo the period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52),
          133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)}
#: Rows of whole classes that a task compares at a time.
TOGETHER = 4096


def byte_values():
    """A random number for each byte."""
    return mixed(np.arange(256, dtype=np.uint64), 55)


def _changes(*columns):
    """First places of the runs of equal values in all ``columns``; windows in a row mostly share their mark."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def byte_marks(length, gram):
    """Marks of the windows of ``length`` bytes of a batch, and their first bytes (in the joined batch)."""
    def find(column):
        data, starts = joined(column)
        n = len(data)
        count = max(n - gram + 1, 0)
        grams = mixed(range_sums(byte_values()[data])(slice(0, count), slice(gram, gram + count)), 6)
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        inside = np.zeros(n, bool)
        if n >= length:
            inside[:n - length + 1] = owner[:n - length + 1] == owner[length - 1:]
        marks, at = window_marks(grams, inside, length - gram + 1)
        whole = owner[:count] == owner[gram - 1:] if count else np.zeros(0, bool)
        return marks, at, owner, starts, grams[whole], owner[:count][whole]
    return find


def _marks_of(length, gram):
    find = byte_marks(length, gram)

    def marks(column):
        found, at, owner, _, grams, gram_owner = find(column)
        own = owner[at]
        first = _changes(own, found)
        return per_text(own[first], found[first], gram_owner, grams)
    return marks


def _windows_of(length, gram):
    """First and past byte (within the text) of the runs of windows whose mark is wanted, per text of a batch."""
    find = byte_marks(length, gram)

    def parts(column, wanted):
        found, at, owner, starts, _, _ = find(column)
        pairs = np.unique(np.concatenate([mixed(np.array(w, np.int64).view(np.uint64) ^ mixed(np.array([i], np.uint64), 21), 22)
                                          for i, w in enumerate(wanted)] or [np.zeros(0, np.uint64)]))
        own = owner[at]
        run = _changes(own, found)
        keep = np.isin(mixed(found[run] ^ mixed(own[run].astype(np.uint64), 21), 22), pairs)
        keep = np.repeat(keep, np.diff(np.append(run, len(at))))
        at, own = at[keep], own[keep]
        # Windows that touch or overlap are one part.
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (at[1:] > at[:-1] + length)
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(at) - 1) if len(at) else first
        return own[first], at[first] - starts[own[first]], at[last] + length - starts[own[first]]
    return parts


def parts_of(texts: DataFrame, length=LENGTH, grams=GRAMS) -> DataFrame:
    """Parts of the texts (as ``candidates`` gives them) that may hold a repeated string: id, key, start (byte), part (binary)."""
    parts = marked_parts(texts.withColumn("start", F.lit(0).cast("bigint")), _windows_of(length, grams[0]))
    for gram in grams[1:]:
        again = candidates(parts.select(F.struct("key", "start").alias("id"), F.col("part").alias("text")), _marks_of(length, gram), "text", id="id")
        parts = marked_parts(again.select("id.key", "id.start", "text", "marks"), _windows_of(length, gram))
    return parts


def stored(df: DataFrame, places) -> DataFrame:
    """``df`` as Parquet in the shared folder; its path is added to ``places``."""
    places.append(new_place(df.sparkSession, "suffixes"))
    df.write.parquet(places[-1])
    return df.sparkSession.read.parquet(places[-1])


def given_up(spark, places):
    """Delete what nothing reads any more."""
    while places:
        removed(spark, places.pop())


def period_of(length):
    """Period of the difference cover for strings of ``length`` bytes: a third of each string, or more, is left to tell suffixes apart."""
    return max(v for v in COVERS if 3 * v <= 2 * length or v == 1)


def samples(parts: DataFrame, length=LENGTH) -> DataFrame:
    """Sampled places of the parts: id, place, after (bytes from there on that strings may cover), mark of the first bytes, c1 and c2 of the surroundings."""
    period = period_of(length)
    share = length - period + 1
    sampled = np.isin(np.arange(period), COVERS[period])

    def sample(batches):
        for batch in pieces(batches, "part", MARKED_BYTES):
            data, starts = joined(batch.column("part"))
            n = len(data)
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            places = np.arange(n) - starts[owner]
            at = np.flatnonzero(sampled[places % period] & (places + share <= np.diff(starts)[owner]))
            marks = mixed(range_sums(byte_values()[data])(at, at + share), 6)
            before = np.minimum(places[at], period - 1)
            after = np.minimum(starts[owner[at] + 1] - at, length)
            whole = data.tobytes()
            digests = [hashlib.md5(whole[a:b]).digest() for a, b in zip((at - before).tolist(), (at + after).tolist())]
            halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
            # Surroundings are the same only if the place is the same in them.
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").take(pa.array(owner[at])), "place": pa.array(places[at].astype(np.int32)),
                "after": pa.array(after.astype(np.int32)), "mark": pa.array(marks.view(np.int64)),
                "c1": pa.array((halves[:, 0] ^ mixed(before.astype(np.uint64), 31)).view(np.int64)),
                "c2": pa.array(halves[:, 1].view(np.int64))})
    return small_batches(parts.select("id", "part")).mapInArrow(sample, "id bigint, place int, after int, mark bigint, c1 bigint, c2 bigint")


def classes(sampled: DataFrame, length=LENGTH, hot=HOT) -> DataFrame:
    """Sampled places that may share a string with another: id, place, after, mark, alone, told, sent, hot.

    Places that are not ``alone`` have equals in all their surroundings, so all strings there are repeated (``told``). The others are to
    be compared with each other and one of each kind that isn't alone (``sent``). Places a multiple of the period apart meet at
    all residues of the cover; the first one is enough, so classes of one other residue are left out.
    """
    by_mark, by_kind = Window.partitionBy("mark"), Window.partitionBy("mark", "c1", "c2")
    several = lambda w: (F.min("residue").over(w) < F.max("residue").over(w)) | (F.max("residue").over(w) == 0)
    count = lambda c, w: F.sum(F.when(c, 1).otherwise(0)).over(w)
    # One order serves all windows.
    ordered = (sampled.withColumn("residue", F.col("place") % period_of(length)).repartition("mark")
               .sortWithinPartitions("mark", "c1", "c2", "id", "place"))
    met = ordered.withColumns({"n": F.count(F.lit(1)).over(by_mark), "several": several(by_mark)}).where("n > 1 AND several")
    kinds = met.withColumns({"alone": F.count(F.lit(1)).over(by_kind) == 1, "told": several(by_kind),
                             "first": F.row_number().over(by_kind.orderBy("id", "place")) == 1})
    sizes = kinds.withColumns({"kinds": count(F.col("first"), by_mark), "singles": count(F.col("alone"), by_mark)})
    sent = F.col("first") & (F.col("kinds") > 1) & (F.col("singles") > 0)
    return sizes.select("id", "place", "after", "mark", "alone", (F.col("told") & ~F.col("alone")).alias("told"), sent.alias("sent"),
                        (F.col("kinds") > hot).alias("hot")).where("told OR sent")


def surroundings(parts: DataFrame, found: DataFrame, length=LENGTH) -> DataFrame:
    """The sent places of ``classes`` with their bytes: id, place, mark, alone, hot, before (how many), bytes."""
    period = period_of(length)
    wanted = found.where("sent").groupBy("id").agg(F.collect_list(F.struct("place", "after", "mark", "alone", "hot")).alias("wanted"))

    def read(batches):
        for batch in pieces(batches, "part"):
            rows = []
            for id, text, places in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist(), batch.column("wanted").to_pylist()):
                for w in places:
                    before = min(w["place"], period - 1)
                    rows.append((id, w["place"], w["mark"], w["alone"], w["hot"], before, text[w["place"] - before:w["place"] + w["after"]]))
            id, place, mark, alone, hot, before, own = zip(*rows) if rows else ([],) * 7
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(id, pa.int64()), "place": pa.array(place, pa.int32()), "mark": pa.array(mark, pa.int64()), "alone": pa.array(alone, pa.bool_()),
                "hot": pa.array(hot, pa.bool_()), "before": pa.array(before, pa.int32()), "bytes": pa.array(own, pa.binary())})
    return small_batches(parts.select("id", "part").join(wanted, "id")).mapInArrow(
        read, "id bigint, place int, mark bigint, alone boolean, hot boolean, before int, bytes binary")


def _ordered(rows):
    """Order of the rows of a byte matrix, and how many first bytes each shares with the row before it in that order (none for the first)."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    other = rows[order[1:]] != rows[order[:-1]]
    shared = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
    return order, np.concatenate(([-1], shared))


def repeated_in(group, before, column, length, period):
    """Whether the string that starts s bytes before a row's place is another row's too: boolean per row and s (0 to ``period`` - 1).

    ``group`` numbers the class of each row; ``column`` has ``before`` bytes before the place and those from there on.
    """
    data, starts = joined(column)
    n, after = len(group), np.diff(starts) - before
    data = np.append(data, np.uint8(0))
    # The class goes first, so that only rows of one class share anything beyond it.
    name = group.astype(">u4").view(np.uint8).reshape(n, 4)

    def matrix(first, step, size, width):
        reach = np.arange(width)
        inside = reach < size[:, None]
        return np.hstack([name, np.where(inside, data[np.where(inside, first[:, None] + step * reach, 0)], 0).astype(np.uint8)])

    place = starts[:-1] + before
    suffix_order, suffix_shared = _ordered(matrix(place, 1, after, length))
    prefix_order, prefix_shared = _ordered(matrix(place - 1, -1, before, period - 1))
    found, suffix_run, prefix_run = np.zeros((n, period), bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for s in range(period):
        rows = np.flatnonzero((before >= s) & (after >= length - s))
        suffix_run[suffix_order] = np.cumsum(suffix_shared < 4 + length - s)
        prefix_run[prefix_order] = np.cumsum(prefix_shared < 4 + s)
        pair = suffix_run[rows] * (n + 1) + prefix_run[rows]
        order = np.argsort(pair)
        same = pair[order[1:]] == pair[order[:-1]]
        found[rows[order[1:][same]], s] = True
        found[rows[order[:-1][same]], s] = True
    return found


def _compare(length):
    """Tasks' work on rows of ``surroundings`` in the order of their marks: runs of repeated strings at places that are alone, as (id, start, past)."""
    period = period_of(length)
    runs_of = lambda id, start, past: pa.RecordBatch.from_pydict(
        {"id": pa.array(id, pa.int64()), "start": pa.array(start, pa.int64()), "past": pa.array(past, pa.int64())})

    def finish(rows):
        marks = rows.column("mark").to_numpy()
        group = np.cumsum(np.append(True, marks[1:] != marks[:-1]))
        found = repeated_in(group, rows.column("before").to_numpy().astype(np.int64), rows.column("bytes"), length, period)
        found &= rows.column("alone").to_numpy(zero_copy_only=False)[:, None]
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, least = np.nonzero(edges == 1)
        past = np.nonzero(edges == -1)[1]
        place = rows.column("place").to_numpy().astype(np.int64)[row]
        return runs_of(rows.column("id").to_numpy()[row], place - past + 1, place - least + 1)

    def compare(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > TOGETHER:
                rows = pa.concat_batches(held)
                marks = rows.column("mark").to_numpy()
                # The last class may go on in the next batch.
                end = int(np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))[-1])
                if end:
                    yield finish(rows.slice(0, end))
                held = [rows.slice(end)]
        if sum(b.num_rows for b in held):
            yield finish(pa.concat_batches(held))
        give_back()
    return compare


def _one_by_one(length):
    """Tasks' work on places of hot classes: each string of theirs by 128 bits."""
    period = period_of(length)

    def strings(batches):
        for batch in pieces(batches, "bytes", PIECE_BYTES >> 7):
            rows = [(id, place - s, alone, hashlib.md5(own[before - s:before - s + length]).digest())
                    for id, place, alone, before, own in zip(*[batch.column(c).to_pylist() for c in ("id", "place", "alone", "before", "bytes")])
                    for s in range(max(0, length - (len(own) - before)), min(before, period - 1) + 1)]
            id, start, alone, string = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_pydict({"id": pa.array(id, pa.int64()), "start": pa.array(start, pa.int64()),
                                              "alone": pa.array(alone, pa.bool_()), "string": pa.array(string, pa.binary())})
    return strings


def repeated(texts: DataFrame, length=LENGTH, grams=GRAMS, hot=HOT) -> DataFrame:
    """Runs of strings of ``length`` bytes that start anywhere else too, in different texts: key, runs (array of first bytes ``start``, ``past``).

    ``texts`` as ``candidates`` gives them. A class of at most ``hot`` different surroundings is one task's; strings of larger ones are counted one by one.
    """
    spark, places = texts.sparkSession, []
    parts = parts_of(texts, length, grams)
    found = stored(classes(samples(parts, length), length, hot), places)
    sent = surroundings(parts, found, length)
    cold = sent.where("NOT hot").select("mark", "id", "place", "alone", "before", "bytes").repartition("mark").sortWithinPartitions("mark")
    compared = small_batches(cold).mapInArrow(_compare(length), "id bigint, start bigint, past bigint")
    single = small_batches(sent.where("hot").select("id", "place", "alone", "before", "bytes")).mapInArrow(
        _one_by_one(length), "id bigint, start bigint, alone boolean, string binary")
    # A string of one class and shift is told from another's by its bytes alone: the same place may come with several classes, and is one.
    single = single.groupBy("string", "id", "start").agg(F.max("alone").alias("alone"))
    again = single.groupBy("string").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("string")
    counted = single.where("alone").join(again, "string").select("id", "start", (F.col("start") + 1).alias("past"))
    place = F.col("place").cast("bigint")
    told = found.where("told").select("id", F.greatest(place - period_of(length) + 1, F.lit(0)).alias("start"), (place + F.col("after") - length + 1).alias("past"))
    runs = compared.unionByName(counted).unionByName(told.where("start < past"))
    result = stored(runs.groupBy("id").agg(F.collect_list(F.struct("start", "past")).alias("own")).join(parts.select("id", "key", F.col("start").alias("at")), "id")
                    .groupBy("key").agg(F.flatten(F.collect_list(F.transform("own", lambda r: F.struct(
                        (r["start"] + F.col("at")).alias("start"), (r["past"] + F.col("at")).alias("past"))))).alias("runs")), [])
    given_up(spark, places)
    return result


def _cut(length):
    def cut(batches):
        for batch in pieces(batches, "text"):
            removed, spans, kept = [], [], []
            runs = batch.column("runs").flatten()
            start, past = runs.field("start").to_numpy(), runs.field("past").to_numpy()
            ends = np.cumsum(pc.list_value_length(batch.column("runs")).to_numpy())
            for text, first, end in zip(batch.column("text").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, start[first:end], 1)
                np.add.at(change, past[first:end] + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum()))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "n_removed": pa.array(removed, pa.int64()),
                                              "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})
    return cut


def verdicts(docs: DataFrame, text="text", length=LENGTH, grams=GRAMS) -> DataFrame:
    """Small table of the texts that lose bytes: key, n_removed, n_spans, kept (binary); one row per different text.

    A text that occurs in several rows and has a whole string loses everything. Null and empty texts lose nothing.
    """
    texts = candidates(docs, _marks_of(length, grams[0]), text)
    own = texts.select("key", "text").join(repeated(texts, length, grams), "key")
    cut = small_batches(own).mapInArrow(_cut(length), "key binary, n_removed bigint, n_spans bigint, kept binary")
    sizes = docs.select(text_key(F.col(text)).alias("key"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_removed"))
    copies = (sizes.groupBy("key").agg(F.max("n_removed").alias("n_removed"), F.count(F.lit(1)).alias("c"))
              .where((F.col("c") > 1) & (F.col("n_removed") >= length))
              .select("key", "n_removed", F.lit(1).cast("bigint").alias("n_spans"), F.lit(b"").alias("kept")))
    one = F.max_by(F.struct("n_removed", "n_spans", "kept"), "n_removed")
    return cut.unionByName(copies).groupBy("key").agg(one.alias("v")).select("key", "v.*")
