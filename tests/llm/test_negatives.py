"""Hard negatives against all scores."""

import math
import random

import numpy as np

from lotlens.llm import catalog, negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, every=50):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [max(-negatives.LIMIT, min(negatives.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, m == label) for i, (m, w) in kept.items() if i != a)
        for p, i, same in [s for s in scored if s[2]][:5]:
            good = [(s, j) for s, j, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(good[:3])]
    return sorted(out)


def clusters(count, dims, labels, seed, spread=0.3):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(labels, dims))
    kinds = draw.integers(0, labels, count)
    return [(int(i), [float(x) for x in (centers[k] + spread * draw.normal(size=dims)).astype(np.float32)], int(k)) for i, k in zip(draw.permutation(count), kinds, strict=True)]


def test_all_pairs(spark, monkeypatch):
    for rows, block, group in ((clusters(900, 17, 6, 1), 5, 200), (clusters(400, 3, 2, 2, 2.0), 2_048, 8_192), (clusters(300, 40, 30, 3, 1.0), 3, 64)):
        monkeypatch.setattr(negatives, "BLOCK", block)
        monkeypatch.setattr(negatives, "GROUP", group)
        got = sorted(map(tuple, negatives.mined(spark.createDataFrame(rows, SCHEMA), 10).collect()))
        assert got == slow(rows, 10) and got


def test_ties_and_equal_vectors(spark):
    draw = random.Random(4)
    few = [[draw.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(4)] for _ in range(6)]
    rows = [(i, draw.choice(few), draw.randrange(3)) for i in range(600)]
    rows += [(10_000 + i, few[0], 1) for i in range(400)]  # a group of copies
    assert sorted(map(tuple, negatives.mined(spark.createDataFrame(rows, SCHEMA)).collect())) == slow(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2), (5, [1.0, 2.0], None),
        (6, [], 1), (7, [1.0], 2), (8, [1.0, 1.0, 5.0], 2), (9, [0.9, 2.1], 1), (10, [1e30, 1.0], 2), (11, [0.5, 1.0], 2), (12, [0.5, 1.1], 2), (-50, [-1.0, -2.0], 2), (50, [1.0, 1.9], 3),
        (100, [-1.0, 0.5], 4), (101, [1.0, -0.5], 4),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS cell", "'x' AS `a.b`", "3 AS rank")
    got = sorted(map(tuple, negatives.mined(frame).collect()))
    assert got == slow(rows) and got
    assert negatives.mined(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_scores_beyond_floats(spark):
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(np.random.default_rng(5).uniform(-2e5, 2e5, (120, 8)))]
    assert sorted(map(tuple, negatives.mined(spark.createDataFrame(rows, SCHEMA), 10).collect())) == slow(rows, 10)


def test_registered_query(spark, sf):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, catalog.op11_bond_negatives(spark, sf).collect())) == slow(rows)


def test_bounds_shrink_the_bitmap():
    rows = clusters(4_000, 32, 10, 6)
    segment = negatives.Segment(np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), np.floor(256 * np.array([r[1] for r in rows])))
    seen = []

    def alive(lower, upper):
        seen.append(len(lower))
        return upper >= np.sort(lower)[-5:][0]

    places, scores = segment.scan(segment.columns[:, 7], np.arange(4_000), alive)
    whole = segment.columns[:, 7] @ segment.columns
    assert sorted(scores)[-5:] == sorted(whole)[-5:] and seen[0] == 4_000 and seen[-1] < 600
