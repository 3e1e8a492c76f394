"""The registered queries' columns against plain versions of what they promise, over whole small tables."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from lendgauge.llm.byte_bpe import encoding
from lendgauge.llm.queries import QUERIES

from test_near_duplicates import true_classes


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows_of(spark, folder, name):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def test_op2(spark, folder, docs, size=200):
    data = {i: (r.text or "").encode() for i, r in docs.items()}
    seen = Counter(d[at:at + size] for d in data.values() for at in range(len(d) - size + 1))
    got = rows_of(spark, folder, "op2_difference_cover_dedup")
    assert {r["doc_id"] for r in got} == set(data) and len(got) == len(data)
    for r in got:
        d = data[r["doc_id"]]
        gone = bytearray(len(d))
        for at in range(len(d) - size + 1):
            if seen[d[at:at + size]] > 1:
                gone[at:at + size] = b"\1" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(d), sum(gone), spans, sha(kept))


def test_op3(spark, folder, docs):
    plain = encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = rows_of(spark, folder, "op3_chunked_byte_bpe")
    assert len(got) == len(docs)
    for r in got:
        ids = plain.encode_ordinary(docs[r["doc_id"]].text or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(docs[r["doc_id"]].text or "")


def test_op4(spark, folder, docs):
    got = rows_of(spark, folder, "op4_language_profiles")
    assert len(got) == len(docs)
    known, right, asked = {r.lang for r in docs.values() if r.lang is not None}, 0, 0
    for r in got:
        doc = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in doc.text or "")
        assert (r["lang_pred"] in known) if letters else r["lang_pred"] == "und"
        if r["held_out"] and doc.lang is not None and letters:
            asked, right = asked + 1, right + (r["lang_pred"] == doc.lang)
    assert asked > 20 and right >= 0.9 * asked


def test_op6(spark, folder):
    chats = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        chats[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = r"\### Assistant: </turn> ok"
    chats[-7] = [(0, "user", said), (1, "assistant", said)]
    got = rows_of(spark, folder, "op6_prefix_target_chat")
    assert {r["conv_id"] for r in got} == set(chats) and len(got) == len(chats)
    for r in got:
        turns = sorted(chats[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] >= sum(len(t) for _, _, t in turns)


def test_op7(spark, folder, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, folder, "op7_winnowing")}
    order = sorted(docs, reverse=True)
    assert set(got) == set(docs)
    by_text = {}
    for at, i in enumerate(order):
        text, following = docs[i].text or "", docs[order[(at + 1) % len(order)]].text or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        for t, f in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert by_text.setdefault(t, f) == f
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if text == following:
            assert r["near_next"] == r["near_edited"] == 1
        elif cut > 200:
            assert r["near_edited"] > 0.2


def test_op8(spark, folder):
    """In these pages an article holds one heading and paragraphs; nothing outside of it is text."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = rows_of(spark, folder, "op8_tag_path_ratios")
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]].html or "", re.S)
        found = re.split(r"</?(?:p|h1)>", inside.group(1)) if inside else []
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in found]
        want = "\n".join(t for t in texts if t)
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]].url, want, len(want))


def test_op10(spark, folder, docs):
    want = true_classes([(i, r.text) for i, r in docs.items()])
    got = rows_of(spark, folder, "op10_dart_minhash")
    assert len(got) == len(docs)
    members = lambda pairs: {frozenset(g) for g in pairs.values()}
    by_class, by_root = defaultdict(set), defaultdict(set)
    for r in got:
        by_class[r["class_id"]].add(r["doc_id"])
    for i, root in want.items():
        by_root[root].add(i)
    assert members(by_class) == members(by_root)
