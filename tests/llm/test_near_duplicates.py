"""DartMinHash classes against all pairs, and the signatures against the similarity they stand for."""

import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

from lendgauge.llm import dart_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    words = WORD.findall(text or "")
    return Counter(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def true_classes(rows, limit=0.8):
    """Smallest id per row by plain comparison of all pairs that share a shingle."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    meet = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            meet[x].add(i)
    for a, b in {(a, b) for m in meet.values() for a in m for b in m if a < b}:
        if similarity(sets[a], sets[b]) >= limit:
            parent[root(b)] = root(a)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[root(i)].append(key)
    return {key: min(g) for g in groups.values() for key in g}


def corpus(seed):
    """Originals, copies with a few words changed, and many texts that share half of their words."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    shared = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(5, 160))]
        texts.append(base)
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    texts += [shared + [word() for _ in range(35)] for _ in range(60)]
    texts += [shared[:3], shared[:3], ["one"], ["to"] * 50, ["to"] * 49]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [128, 6])
def test_classes_are_those_of_all_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(dart_minhash, "links", lambda *a, _f=dart_minhash.links: _f(*a, small=small))
    rows = corpus(small)
    got = dart_minhash.group(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    want = true_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    assert sum(r.is_first for r in got) == len(set(want.values()))


def bridges(groups=2, n=150):
    """Chains from an end over one text to a group of many: the end is like that text only, the text is like all of the group."""
    texts = []
    for g in range(groups):
        changed = lambda base, *at: [f"x{len(texts)}.{i}" if i in at else w for i, w in enumerate(base)]
        middle = [f"g{g}.{i}" for i in range(104)]
        texts += [middle, changed(middle, 20, 60)]
        for i in range(n):
            texts.append(changed(middle, 80 + i % 20))
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def twins(n=120):
    """Texts that share a passage and are 0.78 alike, and each 0.81 like its twin."""
    passage = [f"p{i}" for i in range(81)]
    own = lambda i, j: [f"t{i}.{k}" if k < 2 else f"t{i}.{j}.{k}" for k in range(11)]
    return [(2 * i + j, " ".join(passage + own(i, j))) for i in range(n) for j in range(2)]


@pytest.mark.parametrize("rows, n_classes", [(bridges(), 2), (twins(), 120)])
def test_no_pair_is_lost_in_large_buckets(spark, rows, n_classes, monkeypatch):
    monkeypatch.setattr(dart_minhash, "links", lambda *a, _f=dart_minhash.links: _f(*a, small=6))
    got = dart_minhash.group(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    want = true_classes(rows)
    assert len(set(want.values())) == n_classes
    assert {r.doc_id: r.class_id for r in got} == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "a  b"), (None, "a b"), (7, long), (8, long + " x"), (7, long), (None, None), (9, "same"), (9, "same")]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, key string, class_id int")
    got = dart_minhash.group(table)
    assert got.columns == ["doc_id", "text", "key", "class_id", "is_first"]
    found = [(r.doc_id, r.class_id) for r in got.where("text is not null").collect()]
    assert sorted(found, key=str) == sorted([(2, 2), (3, 3), (4, 4), (5, 4), (None, 4), (7, 7), (8, 7), (7, 7), (9, 9), (9, 9)], key=str)
    assert got.where("is_first").count() == 4 + 3
    assert dart_minhash.group(table.where("false")).count() == 0


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(4)
    element = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = rng.uniform(0.2, 4, 60), rng.uniform(0.2, 4, 60)
    b[:20] = a[:20]
    agree = []
    for shift in range(40):
        owner = np.repeat([0, 1], 60)
        kept = dart_minhash.signatures(owner, np.concatenate([element, element]) + np.uint64(shift), np.concatenate([a, b]), 2)
        assert (kept != 0).all()
        agree.append((kept[0] == kept[1]).mean())
    assert abs(np.mean(agree) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_components_of_long_chains(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 200), (300, 200), (7, 7)], "left int, right int")
    got = {r.node: r["class"] for r in dart_minhash.classes(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 200: 100, 300: 100}
    assert dart_minhash.classes(edges.where("false")).count() == 0


MEASURED = """
import random, resource, sys
sys.path.insert(0, {root!r})
import pandas as pd
from lendgauge.llm import dart_minhash
rng = random.Random(1)
base = ["w%d" % rng.randrange(50_000) for _ in range(20_000)]
texts = []
for i in range(150):
    own = list(base)
    for _ in range(150):
        own[rng.randrange(20_000)] = "x%d" % i
    texts.append(" ".join(own))
rows = pd.DataFrame({{"key": [i.to_bytes(16, "big") for i in range(150)], "text": texts}})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = dart_minhash._links_within(0.8)(rows)
print(len(found), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


def test_memory_of_a_set_of_long_texts():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", MEASURED.format(root=root)], capture_output=True, text=True, timeout=600)
    found, megabytes = out.stdout.split()
    # 18 MB of text, 3 million elements: all are linked, within 16 bytes an element and what sorting them takes.
    assert int(found) == 149 and float(megabytes) < 350, out.stdout + out.stderr
