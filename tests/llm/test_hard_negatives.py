"""Hard negatives against brute force, and the bounds of the summaries."""

import math
import random

import numpy as np
import pytest

from plumbline.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, target int, score string, q int, block string"


def brute(rows, anchor=lambda i: i % 100 == 0, positives=5, negatives=10, band=(30, 90)):
    good = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, q in good:
        if not anchor(i):
            continue
        scores = [(-sum(a * b for a, b in zip(q, o)), j, lab == other) for j, other, o in good]
        for s, j, _ in sorted(x for x in scores if x[2] and x[1] != i)[:positives]:
            ours = sorted(x for x in scores if not x[2] and band[0] * -s <= 100 * -x[0] <= band[1] * -s)[:negatives]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(ours, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "r", 1, "s", 2, "b") for i, v, lab in rows], SCHEMA).repartition(3)


def random_rows(n, dims, seed, spread=0.3):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(5, dims))
    return [(i, [float(x) for x in np.float32((middle[c] + spread * rnd.normal(size=dims)) / math.sqrt(dims))], int(lab)) for i, (c, lab) in enumerate(zip(rnd.integers(0, 5, n), rnd.integers(0, 4, n)))]


@pytest.fixture(scope="module")
def rows():
    rows = random_rows(900, 24, 1)
    rnd = random.Random(2)
    copies = [(1000 + k, rows[rnd.randrange(5)][1], rnd.randrange(4)) for k in range(300)]  # ties and a large group of copies
    odd = [(2000, None, 1), (2100, rows[0][1][:7], 1), (2200, [], 2), (2300, [float("nan")] * 24, 1), (2400, [None] * 24, 1), (2500, rows[1][1], None), (None, rows[2][1], 1), (2600, [float("inf")] + rows[0][1][1:], 1), (2700, [-x for x in rows[3][1]], 3), (2800, [1e6, -1e6] * 12, 0)]
    return rows + copies + odd + [rows[100], rows[100], rows[7], rows[7]]


def test_against_brute_force(spark, rows):
    want = brute(rows)
    df = table(spark, rows)
    got = H.mine(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # blocks of three anchors give what one block gives
    assert len(want) > 100
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, H.mine(df, block=3).collect())) == want


def test_other_numbers(spark):
    rows = random_rows(300, 10, 4)
    got = H.mine(table(spark, rows), anchor="vec_id % 50 = 0", positives=2, negatives=3, band=(10, 60))
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 50 == 0, 2, 3, (10, 60))


def test_empty(spark, rows):
    assert H.mine(table(spark, rows).limit(0)).count() == 0
    assert H.mine(table(spark, rows).filter("vec_id % 100 <> 0")).count() == 0


def test_contract_labels(spark):
    got = {r.vec_id: r.label for r in H.relabelled(table(spark, [(0, [1.0], 9), (7, [1.0], 3), (8, [1.0], 3), (14, [1.0], None), (21, [1.0], 2**31 - 1)])).collect()}
    assert got == {0: 0, 7: 4, 8: 3, 14: None, 21: 8}


@pytest.mark.parametrize("dims", [1, 3, 16, 64, 100])
def test_bounds_hold_and_prune(dims):
    """No pair within reach is lost; on vectors in clusters most others go before they are scored."""
    rnd = np.random.default_rng(dims)
    middle = np.repeat(rnd.normal(size=(4, -(-dims // 8))), 8, axis=1)[:, :dims] * 200
    q = np.floor(middle[rnd.integers(0, 4, 400)] + rnd.normal(size=(400, dims)) * 5).astype(np.int64)
    v = H.Vectors(np.arange(400), np.zeros(400, np.int64), q, *H.summaries(q))
    exact = q @ q.T
    for low, high in ((exact.max() // 2, np.inf), (-10, 10), (exact.min(), exact.min() // 2)):
        r, a = H.survivors(v, v, np.full(400, low, float), np.full(400, high, float), np.ones((400, 400), bool))
        kept = np.zeros((400, 400), bool)
        kept[r, a] = True
        assert kept[(exact >= low) & (exact <= high)].all()
        if dims == 64:
            assert kept.sum() <= 1.2 * ((exact >= low) & (exact <= high)).sum() + 4000
    r, a = np.nonzero(np.ones((400, 400), bool))
    assert (H.scored(v, v, r, a) == exact[r, a]).all() and (H.scored(v, v, r[:99], a[:99]) == exact[r[:99], a[:99]]).all()
    large = H.Vectors(v.ids, v.labels, q << 24, *H.summaries(q << 24))
    assert (H.scored(large, v, r, a) == ((q << 24) @ q.T)[r, a]).all()
