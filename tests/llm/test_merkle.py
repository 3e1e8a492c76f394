"""Merkle trees against plain hashing level by level; addresses of the layout; the registered query."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lendgauge.llm import merkle
from lendgauge.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(digests):
    """Root of a tree and, per leaf, its siblings of every level as (left, right)."""
    ways, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for way, i in zip(ways, at):
            run = digests[i // 16 * 16:i // 16 * 16 + 16]
            way.append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        digests = [sha("".join(digests[i:i + 16])) for i in range(0, len(digests), 16)]
        at = [i // 16 for i in at]
    return digests[0], ways


def plain(trees):
    """(tree, leaf index) -> (subroot, proof, way) and the root of all."""
    made = {t: climb(d) for t, d in trees.items()}
    root, over = climb([made[t][0] for t in sorted(trees, key=str.encode)])
    out = {}
    for way, t in zip(over, sorted(trees, key=str.encode)):
        out |= {(t, i): (made[t][0], sha("".join(a + b for a, b in own + way)), own + way) for i, own in enumerate(made[t][1])}
    return out, root


def fold(digest, way):
    for a, b in way:
        digest = sha(a + digest + b)
    return digest


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_fill_a_tree(levels):
    places = [merkle.address(d, np.arange(16 ** d), levels) for d in range(levels)]
    if levels < 5:
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_in(levels)))
    assert places[0][0] == 0
    # The lower half is laid out subtree by subtree: the children of a lowest inner node stand together.
    if levels in (2, 4):
        assert np.all(np.diff(places[-1].reshape(-1, 16)) == 1)


@pytest.mark.parametrize("height,sizes", [
    (1, {"=a": 300, "=b": 17, "-": 1, "=ä": 16, "=c": 33}), (2, {"=a": 1000, "=b": 256, "=c": 257}), (3, {"=one": 1}), (3, {f"=s{i}": 1 for i in range(40)}),
    (3, {"=a": 5000, "=b": 3})])
def test_trees(spark, height, sizes):
    rng = random.Random(height)
    rows = [(t, i, sha(f"{t}{i}"), None) for t, n in sizes.items() for i in range(n)]
    trees = {t: [sha(f"{t}{i}") for i in range(n)] for t, n in sizes.items()}
    rows = [(t, i, d, d if i % 3 else sha("tampered")) for t, i, d, _ in rows]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "tree string, id long, digest string, shown string").repartition(5)
    made = merkle.manifest(df, height)
    want, root = plain(trees)
    assert made.root == root
    got = {(r.leaf, r.id): r for r in made.proofs().collect()}
    assert len(got) == len(rows)
    for t, i, d, shown in rows:
        r = got[d, i]
        subroot, proof, way = want[t, i]
        assert (r.subroot, r.proof, r.folded) == (subroot, proof, fold(shown, way))
        assert (r.folded == root) == (shown == d)


def odd_documents(spark):
    rng = random.Random(2)
    rows = [(i if i % 7 else None, rng.choice([None, "hot", "hot", "é", "", "-", "=x"]), rng.choice(["en", None]), rng.choice([None, 5, -3]),
             rng.choice([None, "", "ABC äÖ 🙂", "lower", "Long " * 20_000])) for i in range(150)]
    rows += [rows[3]] * 4 + [(None, "hot", "en", 1, "Same")] * 60
    return rows, spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, rank string")


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows):
    trees = {}
    for doc_id, source, lang, n, text in rows:
        key = "-" if source is None else "=" + source
        trees.setdefault(key, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n, text), leaf(doc_id, source, lang, n, lowered(text))))
    trees = {t: sorted(r) for t, r in trees.items()}
    want, root = plain({t: [r[2] for r in rows] for t, rows in trees.items()})
    out = []
    for t, members in trees.items():
        for i, (known, doc_id, own, changed) in enumerate(members):
            subroot, proof, way = want[t, i]
            shown = changed if known and zlib.crc32(str(doc_id).encode()) % 5 == 0 else own
            folded = fold(shown, way)
            out.append((doc_id if known else None, own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def test_query_on_odd_rows(spark, tmp_path):
    rows, df = odd_documents(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op12_merkle_manifest"](spark, f"{tmp_path}/none").count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = QUERIES["op12_merkle_manifest"](spark, FOLDER).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)
    assert 0 < sum(not r.verified for r in got) < len(got) / 2
