"""BPE, language, chat, pages and fingerprints against plain versions on small tables with odd rows."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lendgauge.llm import byte_bpe, chat, language, tag_paths, winnowing
from lendgauge.llm.byte_bpe import encoding

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

TEXTS = [None, "", " ", "a", "it's  a\n\n\n test   ", "x" * 500, "a b " * 300, "日本語テキスト" * 60, "😀 emoji 😀" * 40,
         "  \t\n" * 90 + "end", "don't 'll '' 123abc 4 5 " * 20, "no spaces;but,punctuation." * 30, "it's  a\n\n\n test   "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i else None, t, f"k{i}", i, [i]) for i, t in enumerate(TEXTS)] + [(3, "a", "k3", 3, [3])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, part int, head array<int>")


@pytest.mark.parametrize("chunk, overlap", [(40, 8), (64, 30), (1 << 15, 1 << 9)])
def test_ids_are_those_of_one_pass(odd, chunk, overlap):
    plain = encoding(PATH, PATTERN)
    assert isinstance(plain, tiktoken.Encoding)
    rows = byte_bpe.decode(byte_bpe.encode(odd, PATH, PATTERN, ("doc_id", "text", "part"), chunk=chunk, overlap=overlap), PATH, PATTERN).collect()
    assert len(rows) == len(TEXTS) + 1
    for row in rows:
        assert row.ids == plain.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    digests = byte_bpe.digests(odd, PATH, PATTERN, ("part", "text"), chunk=chunk, overlap=overlap).collect()
    for row in digests:
        ids = plain.encode_ordinary(row.text or "")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_no_rows_no_ids(odd):
    assert byte_bpe.encode(odd.where("false"), PATH, PATTERN).count() == 0


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.held_out(F.col("doc_id"))
    known = language.learn(docs.where(~held))
    told = language.identify(docs.where(held), known).where("lang is not null")
    right, n, low, high = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right > 0.97 and 0 <= low <= high <= 1


def test_languages_of_odd_rows(odd):
    known = language.learn(odd.withColumn("lang", F.when(F.col("part") > 3, "xx")))
    told = language.identify(odd.withColumn("score", F.lit("old")), known)
    rows = told.collect()
    assert told.columns == ["doc_id", "text", "key", "part", "head", "lang_pred", "score"] and len(rows) == len(TEXTS) + 1
    assert {r.lang_pred for r in rows if not r.text or not any(c.isalpha() for c in r.text)} == {"und"}
    assert {r.lang_pred for r in rows if r.text and any(c.isalpha() for c in r.text)} == {"xx"}
    assert {r.lang_pred for r in language.identify(odd, language.learn(odd.where("false").withColumn("lang", F.lit("a")))).collect()} == {"und"}


def test_a_long_text_is_bundled_in_slices(monkeypatch):
    text = "the quick brown fox " * 200
    whole, _ = language.bundles([text, "abc"], [0, 1], 2)
    monkeypatch.setattr(language, "SLICE", 64)
    monkeypatch.setattr(language, "BOUND_AT_ONCE", 7)
    parts, _ = language.bundles([text, "abc"], [0, 1], 2)
    assert (whole == parts).all()


NASTY = ["", None, "### user: hi", "\n</turn>\n", r"\### Assistant: </turn> ok", "\\\\</turn>\\", "#####", "###\\###", "a\n</turn>\n### x: y", "\\", "😀###"]


def test_chats_are_read_back(spark):
    rng = random.Random(5)
    parts = ["###", "\\", "</turn>", "\n", "#", "a", "$0", "$1", " ", ": "]
    texts = NASTY + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(120)]
    roles = ["user", "assistant", None, "a: b", "tool/π", ""]
    rows = [(c if c else None, t % 4, roles[rng.randrange(6)], rng.choice(texts), "x") for c in range(25) for t in range(rng.randrange(1, 8))]
    rows += [(99, 0, "assistant", "same", "x")] * 2
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, chars string")
    back = {r.conv_id: r for r in chat.read_back(chat.examples(table)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [t[1:] for t in turns]
        assert back[conv].loss == "".join(t[2] for t in turns if t[1] == "assistant")
    assert len(back) == 26


def test_every_assistant_turn_has_one_example(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (2, 0, "user", "alone")]
    got = chat.examples(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).orderBy("conv_id", "n_turns").collect()
    assert [(r.conv_id, r.target_turn, r.text[r.loss_start:r.loss_end], r.complete) for r in got] == [
        (1, 2, "a", False), (1, None, "", True), (2, None, "", True)]
    assert got[0].text == "### system: s\n</turn>\n### user: u\n</turn>\n### assistant: a\n</turn>\n"
    assert chat.examples(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


PAGES = {
    "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home page of this place</a></li></ul></nav>"
    "<header>Masthead text, with words.</header><div class='ad'>Buy now, pay later.</div><article><h1>A title</h1>"
    "<p>First   paragraph,\n with <b>bold</b> words &amp; more.<p>Second one: unclosed.<ul><li>Item one, here.<li>Item two, there.</ul></article>"
    "<section id='comments'><p>I read this, and I liked it a lot.</p></section><aside>Side, bar.</aside>"
    "<form><p>Your name, please.</p><input></form><script>var t='</p>';</script><footer>&copy; us</footer></body></html>":
        "A title\nFirst paragraph, with bold words & more.\nSecond one: unclosed.\nItem one, here.\nItem two, there.",
    "<body><div class='cookie-notice'>We use cookies, click.</div><main><p>Only text.</p></main></body>": "Only text.",
    "<p>Bare paragraph, no frame.</p>": "Bare paragraph, no frame.",
    "plain text, no markup": "plain text, no markup", "": "", "<nav>menu</nav>": "", "<!-- <p>x</p> --><p>a &lt;b&gt; c</p>": "a <b> c",
    "<article><p>Broken <a href=\"x>text": "Broken",
    "<article><h1>T</h1><p>Long text, of the first paragraph, here.</p><h2><a href='/x'>Linked heading</a></h2><p>More, of it.</p></article>":
        "T\nLong text, of the first paragraph, here.\nLinked heading\nMore, of it.",
    "<article>" + "<p>Long, long text, with marks, and so on, and on.</p>" * 40 + "<table><tr><th>a<th>b<tr><td>1<td>2</table></article>":
        "\n".join(["Long, long text, with marks, and so on, and on."] * 40 + ["a", "b", "1", "2"]),
    "<article><div class='post-header'><h1>Title</h1></div><div class='share-price notice'><p>Text body.</p></div><div class='notice'>N.</div></article>":
        "Title\nText body.",
    "<article><p>One <span class='ad'>Buy <span>now</span>, here</span>two.</p><div class='ad-slot'>Ad.</div><a class='ad' href='/'><div>Big ad</div></a>"
    "<p>Three.</p><section class='comments'><p>I liked it, all of it, very much.</p></section><footer>End</footer></article>":
        "One two.\nThree.",
    "<article><p>The text, which is long enough, is here.</p><p>Unclosed <span class='ad'>buy</p><p>goes on.</p></article>":
        "The text, which is long enough, is here.\nUnclosed\ngoes on.",
    "<main><h1><a href='/'>Head</a></h1><article><p>Own text, of this page, is here.</p></article>"
    "<article><h2><a href='/b'>Another page</a></h2></article></main>": "Head\nOwn text, of this page, is here.",
    "<main><p>Text, in main.</p><ol><li><a href='r'>A reference</a></li></ol></main>": "Text, in main.\nA reference",
    "<body><div class='ad'><article>Ad text, long, long, long.</article></div><article class='comment-body'>Hi, all.</article>"
    "<div><p>The article, with no frame.</p></div></body>": "The article, with no frame.",
}


def test_main_text_of_pages(spark):
    rows = [(i, h, "x", "old") for i, h in enumerate(PAGES)] + [(None, None, "x", "old"), (0, next(iter(PAGES)), "x", "old")]
    got = tag_paths.extract(spark.createDataFrame(rows, "page_id int, html string, url string, text string")).collect()
    want = [*PAGES.values(), "", next(iter(PAGES.values()))]
    assert [r.page_id for r in got] == [r[0] for r in rows]
    for row, text in zip(got, want):
        if text != "Broken":
            assert row.text == text
    assert tag_paths.content("<article>" + "<p>long, text.</p>" * 5000 + "</article>").count("\n") == 4999


def fingerprint(text, k, w):
    """Hashes that plain winnowing selects."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashed = lambda g: signed((xxhash.xxh64(g.encode(), seed=42).intdigest() << 13) & (2 ** 64 - 1)) >> 13
    grams = [hashed(text[i:i + k]) for i in range(len(text) - k + 1)] or ([hashed(text)] if text else [])
    out = []
    for i in range(max(len(grams) - w + 1, 1) if grams else 0):
        window = grams[i:i + w]
        least = min(window)
        out.append((i + max(j for j, h in enumerate(window) if h == least), least))
    return sorted(set(out))


def test_selected_grams(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "BLOCK", 64)
    texts = [t for t in TEXTS if t] + ["abcabcabc" * 30, "z" * 47, "z" * 46, "𝒳y𝒳" * 50]
    table = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")
    for row in table.withColumn("grams", winnowing.selected(F.col("text"))).collect():
        assert [(g.place, g.hash) for g in row.grams] == fingerprint(row.text or "", 16, 32)


def test_spliced_is_the_fingerprint_of_the_whole(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.choice([0, 3, 15, 16, 46, 47, 48, 93, 200, 700]))) for _ in range(40)]
    pairs = [(a, b, rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)) for a in texts[:20] for b in texts[20:]][::3]
    table = spark.createDataFrame(pairs, "a string, b string, cut int, taken int")
    joined = F.concat(F.substring(F.col("a"), F.lit(1), F.col("cut")), F.substring(F.col("b"), F.lit(1), F.col("taken")))
    made = (table.withColumn("text", joined).withColumn("ga", winnowing.selected(F.col("a"))).withColumn("gb", winnowing.selected(F.col("b")))
            .withColumn("got", winnowing.spliced(F.col("ga"), F.col("cut"), F.col("gb"), F.col("taken"), F.col("text"))))
    for row in made.collect():
        assert set(row.got) == {h for _, h in fingerprint(row.text, 16, 32)}


def test_next_document(spark):
    rows = [(i, f"t{i}") for i in (5, 1, 9, 3, 7, -2)] + [(None, "n"), (3, "t3b")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = {b[1]: a[1] for a, b in zip(order[1:] + order[:1], order)}
    for buckets in (2, 4, 1024):
        got = winnowing.with_next(table, {"n": F.length("text")}, buckets=buckets).collect()
        assert {r.text: r.next_text for r in got} == want and len(got) == len(rows)
    assert winnowing.with_next(table.where("false"), {"n": F.length("text")}).count() == 0
    assert winnowing.with_next(table.where("doc_id = 5"), {"n": F.length("text")}).first().next_text == "t5"
