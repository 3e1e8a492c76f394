"""The digest index against plain grouping, over batches, replays, reopening and odd rows."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from lendgauge.llm import exact_dedup
from lendgauge.session import shared_folder

WHITE = re.compile(r"[\x20\x09-\x0D]")


def place(spark):
    return f"{shared_folder(spark)}/test-digests-{uuid.uuid4().hex}"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, copies string, batch string")


def odd_rows():
    rng = random.Random(5)
    words = ["a", "b c", "b\tc", "b c ", "bc", "", " ", None, " ", "é", "é", "x" * 200_000, "x " * 200_000, "🙂\n", "🙂"]
    rows = [(i, rng.choice(words)) for i in range(300)] + [(7, "b c"), (7, "b c"), (None, "b c"), (None, "b c"), (None, "only here"), (None, "only here")]
    # One group holds a third of all rows.
    rows += [(1000 + i, "hot" + " " * (i % 3)) for i in range(150)]
    rng.shuffle(rows)
    return [(i, t, "clash", "clash", "clash") for i, t in rows]


def plain(rows):
    """Rows (doc_id, keep_id, group_size, kept) in any order."""
    groups = {}
    for r in rows:
        groups.setdefault(WHITE.sub("", r[1] or ""), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    out = []
    for members in groups.values():
        members.sort(key=lambda m: m[:3])
        out += [(m[3], members[0][3], len(members), i == 0) for i, m in enumerate(members)]
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [500, 3])
def test_one_batch(spark, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup.join_counted, "__defaults__", (hot,))
    rows = odd_rows()
    index = exact_dedup.DigestIndex.create(spark, place(spark), 3)
    assert told(index.add(exact_dedup.digests(table(spark, rows)), "it's")) == plain(rows)
    assert index.rows().count() == len({WHITE.sub("", r[1] or "") for r in rows})


def test_batches_replays_and_reopening(spark):
    rows = odd_rows()
    first, second = rows[:200], rows[200:]
    path = place(spark)
    index = exact_dedup.DigestIndex.create(spark, path, 3)
    index.add(exact_dedup.digests(table(spark, first)), "1").count()
    before = {bytes(r.digest): r.keep_id for r in index.rows().collect()}
    spark.sql(f"DROP TABLE {index.name}")
    again = exact_dedup.DigestIndex(spark, path)
    assert again.buckets == 3 and {bytes(r.digest): r.keep_id for r in again.rows().collect()} == before
    slim = exact_dedup.digests(table(spark, second))
    once = told(again.add(slim, "2"))
    # Adding a batch again leaves one copy of it and says the same.
    assert told(again.add(slim, "2")) == once
    rows_of = {bytes(r.digest): r for r in again.rows().collect()}
    assert len(rows_of) == again.rows().count() == len({WHITE.sub("", r[1] or "") for r in rows})
    assert all(rows_of[d].keep_id == k for d, k in before.items())
    known = {WHITE.sub("", r[1] or "") for r in first}
    assert sum(kept for *_, kept in once) == len({WHITE.sub("", r[1] or "") for r in second} - known)
    small = again.compacted(place(spark), 2)
    assert small.buckets == 2 and {bytes(r.digest) for r in small.rows().collect()} == set(rows_of)
    none = exact_dedup.digests(table(spark, []))
    assert again.add(none, "empty").count() == 0 and small.fresh(slim.groupBy("digest").count(), "3").count() == 0


def test_buckets_are_read_without_a_shuffle(spark):
    index = exact_dedup.DigestIndex.create(spark, place(spark), 4)
    index.add(exact_dedup.digests(table(spark, odd_rows())), "1").count()
    groups = spark.createDataFrame([(bytes(32),)], "digest binary").repartition(4, "digest")
    plan = index.fresh(groups, "2")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 4 out of 4" in plan and plan.count("Exchange") == 1


def test_white_space_only(spark):
    rows = [(i, "".join(map(chr, range(code, code + 1))) + "x") for i, code in enumerate([*range(8, 15), 0x1C, 0x20, 0x85, 0xA0, 0x2028])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("text", exact_dedup.normalised(F.col("text")).alias("n"))
    assert all(r.n == WHITE.sub("", r.text) for r in df.collect())
