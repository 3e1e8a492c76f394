"""Mixing, top-k search and repeated strings against plain versions; registered statements; the pipeline."""

import os
import random
import re
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from lendgauge.llm import bit_sliced, language, mixing, suffix_array, super_kmers  # noqa: E402
from lendgauge.llm.queries import QUERIES, STATEMENTS  # noqa: E402
from lendgauge.llm.repeats import text_key  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_statement(spark, name):
    assert compare(connect(FOLDER), spark, FOLDER, QUERIES[name], STATEMENTS[name]) is None


def plain_targets(sizes):
    """Targets by sharing the excess again until none is above three times its source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    goal, full, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return goal | share
        for s in above:
            goal[s] = 3 * sizes[s]
            left -= goal[s]
            full.add(s)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "a", "b", "Ä", "zz", "zz", "zz", "zz"]), rng.choice([0, 1, 5, 40, 300, 900])) for i in range(600)]
    rows += [(1000 + i, "tiny", 2) for i in range(3)] + [(None, "a", 40), (7, "empty", 0)] + [(5, "b", 5)] * 4
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, source string, size bigint, weight string").withColumn("grade", mixing.grade(F.col("size")))
    got = mixing.mix(table, buckets=16).collect()
    again = mixing.mix(table.repartition(5), buckets=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    goal, taken = plain_targets(sizes), Counter()
    for r in got:
        assert 0 <= r.copies <= 3 and abs(r.target - goal[r.source]) < 1e-3 and r.source_size == sizes[r.source]
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 450, s
    assert mixing.mix(table.where("false")).count() == 0


def plain_top(rows, k):
    out = {}
    for q, v in set(rows):
        if q is not None and v is not None and q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i is not None and w is not None and i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("block", [7, 1 << 14])
def test_top_of_odd_vectors(spark, block):
    rng = random.Random(block)
    rows = [(i, tuple(rng.choice([-300, -7, 0, 0, 3, 260]) for _ in range(5))) for i in range(0, 320)]
    rows += [(1000 + i, (1, 1, 1, 1, 1)) for i in range(40)] + [(50, rows[50][1]), (None, (1, 2, 3, 4, 5)), (4000, None)]
    # Repeated rows, one of them the best of many queries and there more often than the ranks asked for.
    rows += [(2000, (260, 260, 260, 260, 260))] * 3 + [(2001, (-300, 260, 3, -300, 0))] * 9 + [rows[7]]
    table = spark.createDataFrame([(i, list(v) if v else None, "x") for i, v in rows], "id bigint, vector array<bigint>, block string")
    got = bit_sliced.search(table.where("id % 50 = 0"), table, 5, block_rows=block, query_rows=3).collect()
    want = plain_top(rows, 5)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == want
    assert bit_sliced.search(table.where("false"), table, 5).count() == 0
    few = table.where("id in (50, 51)").dropDuplicates(["id"])
    assert bit_sliced.search(few.where("id = 50"), few, 5).count() == 1


def test_unusable_vectors(spark):
    rows = [([0.5, -0.001],), ([float("nan"), 1.0],), ([float("inf")],), ([None, 1.0],), (None,), ([],)]
    got = spark.createDataFrame(rows, "v array<float>").select(bit_sliced.quantised(F.col("v")).alias("q")).collect()
    assert [r.q for r in got] == [[128, -1], None, None, None, None, []]


def plain_repeats(texts, split, size):
    """Per text: flags of the elements that a repeated window of ``size`` covers."""
    parts = [split(t) for t in texts]
    count = Counter(tuple(p[i:i + size]) for p in parts for i in range(len(p) - size + 1))
    out = []
    for p in parts:
        gone = [False] * len(p)
        for i in range(len(p) - size + 1):
            if count[tuple(p[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append((p, gone))
    return out


def passages(seed, word, join):
    """Texts with shared passages around the wanted length, copies, self-repeats and odd rows."""
    rng = random.Random(seed)
    run = lambda n: [word(rng) for _ in range(n)]
    shared = [run(n) for n in (10, 11, 12, 13, 20, 60)]
    texts = []
    for _ in range(40):
        t = run(rng.choice([0, 5, 40, 120]))
        for _ in range(2):
            at = rng.randrange(len(t) + 1)
            t[at:at] = rng.choice(shared)
        texts.append(join(rng, t))
    same = word(rng)
    texts += [join(rng, [same] * 12), join(rng, [same] * 30), join(rng, [same, "q"] * 9), texts[3], texts[3], "", None, join(rng, shared[5] * 2)]
    return texts


@pytest.mark.parametrize("hot", [5000, 2])
def test_repeated_words(spark, hot):
    texts = passages(3, lambda r: "w%d" % r.randrange(400), lambda r, t: "".join(w + r.choice([" ", "\n", " \t"]) for w in t))
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, key string")
    kept = {r.doc_id: r.text for r in super_kmers.strip(table, window=12, gram=4, hot=hot).collect()}
    removed = {bytes(r.key): r.n_removed for r in super_kmers.verdicts(table, window=12, gram=4, hot=hot).collect()}
    keys = {r.doc_id: bytes(r.k) for r in table.select("doc_id", text_key(F.col("text")).alias("k")).collect()}
    for i, (words, gone) in enumerate(plain_repeats(texts, lambda t: WORD.findall(t or ""), 12)):
        assert WORD.findall(kept[i] or "") == [w for w, g in zip(words, gone) if not g]
        assert removed.get(keys[i], 0) == sum(gone)
        if not any(gone):
            assert kept[i] == texts[i]
    assert super_kmers.strip(table.where("false")).count() == 0


def test_repeated_bytes(spark):
    texts = passages(4, lambda r: r.choice("abé"), lambda r, t: "".join(t)) + ["é" * 30 + "z", "y" + "é" * 30]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, part string")
    found = {bytes(r.key): r for r in suffix_array.verdicts(table, length=20, grams=(6, 14, 18)).collect()}
    keys = {r.doc_id: bytes(r.k) for r in table.select("doc_id", text_key(F.col("text")).alias("k")).collect()}
    for i, (data, gone) in enumerate(plain_repeats(texts, lambda t: (t or "").encode(), 20)):
        got = found.get(keys[i])
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        want = (sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g))
        assert ((got.n_removed, got.n_spans, bytes(got.kept)) if got else (0, 0, data)) == want
    assert suffix_array.verdicts(table.where("false")).count() == 0


def test_covers_hold_every_difference_once():
    for period, cover in suffix_array.COVERS.items():
        met = Counter((a - b) % period for a in cover for b in cover if a != b)
        assert cover[0] == 0 and met == Counter(range(1, period))


@pytest.mark.parametrize("hot", [1, 5000])
def test_repeated_bytes_of_large_classes(spark, hot):
    texts = passages(6, lambda r: r.choice("abé"), lambda r, t: "".join(t)) + ["q" * 90, "\0" * 50 + "a", "b" + "\0" * 60]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    once = table.where("text IS NOT NULL").dropDuplicates(["text"])
    found = suffix_array.repeated(suffix_array.candidates(once, suffix_array._marks_of(20, 6)), 20, (6,), hot).collect()
    runs = {bytes(r.key): r.runs for r in found}
    rows = once.select("text", text_key(F.col("text")).alias("k")).collect()
    for r, (data, gone) in zip(rows, plain_repeats([r.text for r in rows], str.encode, 20)):
        covered = [False] * len(data)
        for run in runs.get(bytes(r.k), []):
            assert 0 <= run.start < run.past <= len(data) - 19
            covered[run.start:run.past + 19] = [True] * (run.past + 19 - run.start)
        assert covered == list(map(bool, gone))


def test_near_copies_send_only_what_is_near_their_edits(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghij ") for _ in range(20000))
    copies = [text, text[:9000] + "#" + text[9001:], "shifted" + text[:15000] + "#" + text[15001:]]
    parts = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(copies)], "id bigint, part binary")
    found = suffix_array.classes(suffix_array.samples(parts))
    # Places of the cover within 200 bytes of an edit or an end, not the 60,000 strings.
    assert 0 < found.where("sent").count() < 500
    sent = suffix_array.surroundings(parts, found)
    assert sent.agg(F.max(F.length("bytes"))).first()[0] <= 332


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = docs.limit(1).select((F.lit(900000) + 1).cast("bigint").alias("doc_id"), F.lit("123 456 !!").alias("text"), "lang", "source", "n_chars")
    odd = docs.unionByName(extra).unionByName(extra.withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.lit(None).cast("string"))).withColumn("extra", F.lit("x"))
    kept = corpus_pipeline.language_stage(spark, odd, FOLDER)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}
    first = corpus_pipeline.near_duplicate_stage(spark, kept, FOLDER)
    assert first.columns == odd.columns and first.select("doc_id").distinct().count() == first.count() < kept.count()
    mixed = corpus_pipeline.mixing_stage(spark, first, FOLDER)
    assert mixed.columns == odd.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    rows = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "n_tokens", "ids"} <= set(rows.columns) and rows.where("n_tokens <> size(ids)").count() == 0
    assert 0 < rows.count() < 3 * docs.count()


def test_texts_of_unlearned_scripts_are_rejected(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rng = random.Random(3)
    strange = ["".join(rng.choice("абвгдежзиклмнопрстуф ") for _ in range(rng.choice([20, 60, 300, 2000]))) + "я" for _ in range(300)]
    short = ["the", "and the", "est la", "der"]
    planted = spark.createDataFrame([(700000 + i, t) for i, t in enumerate(strange)] + [(800000 + i, t) for i, t in enumerate(short)], "doc_id long, text string")
    odd = docs.unionByName(planted, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, odd, FOLDER).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} | {800000 + i for i in range(len(short))}


def test_a_few_labelled_texts_teach_no_script(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rng = random.Random(4)
    strange = lambda n: "".join(rng.choice("абвгдежзиклмнопрстуф ") for _ in range(n)) + "я"
    # One labelled text of a strange script, in five rows; crc32 decides who may teach, so several ids are given.
    long = strange(3000)
    taught = spark.createDataFrame([(600000 + i, long, "en") for i in range(5)], "doc_id long, text string, lang string")
    planted = spark.createDataFrame([(700000 + i, strange(300)) for i in range(50)], "doc_id long, text string")
    nothing = spark.createDataFrame([(None, None, "en"), (600100, "", "en"), (600101, "a", None)], "doc_id long, text string, lang string")
    odd = docs.union(docs).unionByName(taught, allowMissingColumns=True).unionByName(planted, allowMissingColumns=True).unionByName(nothing, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, odd, FOLDER).select("doc_id").collect()}
    assert not {i for i in kept if 600000 <= i < 600005 or 700000 <= i < 700050} and {r.doc_id for r in docs.select("doc_id").collect()} <= kept


def test_known_trigrams_count_texts_of_a_language(spark):
    rows = [("abc", "x")] * 19 + [("zzz", "x")] + [("qqq", None), (None, "x"), ("", "x")] + [("mno", "y")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    tell = spark.createDataFrame([("abc",), ("zzz",), ("qqq",), ("mno",), ("",)], "text string")
    for share, wanted in ((0.05, {"abc", "mno"}), (1 / 21, {"abc", "mno", "zzz"})):
        known = language.known_trigrams(docs, learned_from=share)
        assert {r.text for r in language.with_known_share(tell, known).where("known > 0.5").collect()} == wanted
    assert not language.known_trigrams(docs.where("false")).any()


def test_empty_tables_pass_all_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
    assert language.learn(docs.withColumn("text", F.lit("a"))) == {}
