"""The prefix trie against plain sums over all beginnings; centroid sums on forests of every shape; the registered query."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lendgauge.llm import prefix_trie
from lendgauge.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """Nodes of the rebuilt conversations, as tuples of COLUMNS."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
        ends[built].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, convs in members.items()), key=repr)


def subtree_sums(up, values):
    sums = [list(v) for v in values]
    for i in reversed(range(len(up))):
        if up[i] >= 0:
            sums[up[i]] = [a + b for a, b in zip(sums[up[i]], sums[i])]
    return sums


@pytest.mark.parametrize("shape", ["path", "star", "caterpillar", "binary", "random", "forest", "none"])
@pytest.mark.parametrize("weigh", ["leaves", "nothing", "nodes"])
def test_centroid_sums(shape, weigh):
    rng = random.Random(3)
    n = 0 if shape == "none" else 400
    up = [-1] + [{"path": i - 1, "star": 0, "caterpillar": i - 1 if i % 2 else max(i - 2, 0), "binary": (i - 1) // 2,
                  "random": rng.randrange(i), "forest": rng.randrange(-1, i), "none": 0}[shape] for i in range(1, n)] if n else []
    values = [(rng.randrange(10), 1) for _ in up]
    inner = {p for p in up}
    own = [{"leaves": i not in inner, "nothing": 0, "nodes": 1}[weigh] for i in range(n)]
    weight = [w[0] for w in subtree_sums(up, [(int(o),) for o in own])]
    assert prefix_trie.rollup(up, weight, values) == subtree_sums(up, values)


def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(160):
        n = rng.choice([1, 2, 5, 9, 12])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é🙂"])) for t in range(n)]
    # A third of all conversations are alike; a long one branches off everywhere; nulls, ties, repeated rows, an absent first one.
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1100) for t in range(10)]
    rows += [(5000, t, "user", f"long {t}") for t in range(600)]
    for k in range(1, 5):
        rows += [(5000 + k, t, "user", f"long {t}") for t in range(600 - 140 * k)] + [(5000 + k, 900 + k, "user", "own")]
    rows += [(-7, 0, "user", "x"), (-5, 1, None, None), (-5, None, "user", ""), (-5, None, "user", "z"), (None, 0, "user", "nobody"), (7003, 0, "user", "y")]
    rows += [(-5, 1, None, None)] * 3 + [(9000, 0, "", ""), (9000, 0, None, "")]
    rng.shuffle(rows)
    return rows


def write(spark, rows, path):
    wide = [(*r, "clash", "clash", 1) for r in rows]
    spark.createDataFrame(wide, "conv_id long, turn int, role string, text string, key string, path string, w int").write.parquet(f"{path}/conversations.parquet")


@pytest.mark.parametrize("small,hot", [(4096, 500), (3, 500), (3, 2)])
def test_rebuilt_conversations(spark, tmp_path, monkeypatch, small, hot):
    monkeypatch.setattr(prefix_trie.subtree_sums, "__defaults__", (small,))
    monkeypatch.setattr(prefix_trie.trie, "__defaults__", (small,))
    monkeypatch.setattr(prefix_trie.join_counted, "__defaults__", (hot,))
    rows = conversations()
    write(spark, rows, tmp_path)
    got = QUERIES["op11_centroid_trie"](spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_empty_table(spark, tmp_path):
    write(spark, [], tmp_path)
    assert QUERIES["op11_centroid_trie"](spark, str(tmp_path)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_centroid_trie"](spark, FOLDER).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
