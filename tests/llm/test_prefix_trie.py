"""The prefix trie against a trie built turn by turn, for shards and blocks of any size."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from plumbline.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int, path string, words int, depth string, n_convs int"


def brute(rows):
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    new = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, path in new.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(new[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, "d", 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    lines = ["yes", "no way\n", "", None, "a b\x0bc \x85d", "é 中", "### x: ok"]
    rows = [(c, t, rnd.choice(("user", "user", None)), rnd.choice(lines)) for c in range(130) if c not in (40, 60) for t in range(rnd.choice((1, 1, 2, 3, 4, 5, 7, 9, 12)))]
    rows += [(c, t, "user", "copy") for c in range(200, 330) for t in range(6)]  # a large group of copies
    rows += [(c, t, "user", f"long {t if t < 50 else t % (c - 398)}") for c in (400, 401, 402, 405) for t in range(60 + c % 5)]
    rows += [(7, None, "user", "null turn"), (7, None, None, None), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (8, 0, "user", "other tie"), (None, 0, "user", "nobody's"), (9, 1, "user", "x" * 5000)]
    return rows


@pytest.mark.parametrize("block, shard_rows", [(256, 50_000), (256, 20), (3, 15), (4, 1000), (1, 40)])
def test_against_brute_force(spark, rows, block, shard_rows):
    got = prefix_trie.trie(table(spark, rows), block, shard_rows)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_small_tables(spark):
    assert prefix_trie.trie(table(spark, [])).count() == 0
    assert prefix_trie.trie(table(spark, [(None, 0, "user", "x")])).count() == 0
    for rows in ([(2, 0, "user", "one turn")], [(c, 0, "user", "one turn") for c in range(45)]):
        assert sorted(map(tuple, prefix_trie.trie(table(spark, rows), shard_rows=4).collect()), key=repr) == brute(rows)


def test_skeleton_holds_the_splitters_only():
    s = prefix_trie.Skeleton([([b"r", b"a", b"b"], [0, 1, 2]), ([b"r", b"a", b"c"], [0, 1, 3]), ([b"q"], [0])])
    assert sorted(s.rows()) == [(1, 0, 0, 0, [1]), (2, 0, 0, 1, [2]), (3, 2, 1, 2, [3, 2]), (4, 3, 2, 0, [4, 3, 2]), (5, 3, 3, 0, [5, 3, 2])]
