"""The pipeline's near-duplicates through the operator's trees: wide SimHash, shards, components; what a stage leaves on disk."""

import os
import uuid

import numpy as np
import pytest

from lotlens.llm import likeness, simhash
from lotlens.session import run_folder


def edited(draw, size, share):
    """Two sets of hashes of likeness ``share`` or a little more."""
    a = draw.integers(0, 2**63, size, dtype=np.uint64)
    change = int(size * (1 - share) / (1 + share))
    b = np.concatenate([a[change:], draw.integers(0, 2**63, change, dtype=np.uint64)])
    assert len(np.intersect1d(a, b)) >= share * len(np.union1d(a, b))
    return a, b


def points(prints):
    return np.frombuffer(b"".join(prints), dtype=np.uint64).reshape(-1, simhash.WIDE // 64)


def test_alike_sets_have_near_wide_fingerprints_and_unlike_ones_have_not():
    draw, near, far = np.random.default_rng(1), [], []
    for size in [*range(4, 60), 300, 4000]:
        for _ in range(10):
            a, b = edited(draw, size, 0.8)
            pair = points([simhash.wide(a), simhash.wide(b)])
            near.append(simhash._apart(pair[:1], pair[1:])[0, 0])
            pair = points([simhash.wide(a), simhash.wide(draw.integers(0, 2**63, size, dtype=np.uint64))])
            far.append(simhash._apart(pair[:1], pair[1:])[0, 0])
    assert np.mean(np.array(near) <= simhash.WIDE_RADIUS) >= 0.999 and min(far) > simhash.WIDE_RADIUS
    assert simhash.wide(np.zeros(0, np.uint64)) == bytes(simhash.WIDE // 8)


@pytest.mark.parametrize("hot", [0, 400])
def test_links_of_a_shard_equal_all_pairs(hot):
    """Also with many rows in a ball, which are not compared with each other, and rows at its rim."""
    draw = np.random.default_rng(2)
    center = draw.integers(0, 2**64, 4, dtype=np.uint64)

    def moved(bits):
        flips = np.zeros(256, dtype=np.uint8)
        flips[draw.choice(256, bits, replace=False)] = 1
        return center ^ np.packbits(flips).view(np.uint64)

    rows = [moved(int(b)) for b in draw.integers(0, 30, hot)] + [moved(int(b)) for b in draw.integers(30, 120, 60)]
    rows = np.array(rows + list(draw.integers(0, 2**64, (500, 4), dtype=np.uint64)))[draw.permutation(hot + 560)]
    i, j = np.nonzero(simhash._apart(rows, rows) <= simhash.WIDE_RADIUS)
    expected = simhash.components(len(rows), i, j)
    assert len(set(expected.tolist())) < len(rows)
    assert simhash.wide_links(rows).tolist() == expected.tolist()


def test_trees_bring_alike_sets_together_over_many_shards(spark):
    draw, rows, partner = np.random.default_rng(3), [], {}
    for _ in range(700):
        names = [uuid.UUID(int=int(x)).bytes for x in draw.integers(1, 2**62, 2)]
        rows += [(bytes(n), bytearray(simhash.wide(s))) for n, s in zip(names, edited(draw, 120, 0.8), strict=True)]
        partner[names[0]] = names[1]
    prints = spark.createDataFrame([(bytearray(a), b) for a, b in rows], "fp binary, print binary").repartition(5)
    sample = points([bytes(b) for _, b in rows])
    forest = simhash.wide_forest(sample, len(rows), shard_rows=64)
    assert len(forest) == simhash.n_trees(len(rows), 64) > 10 and all(tree.shards >= 16 for tree in forest)
    for tree in forest:
        placed = [(shard, row) for shard, found, home in tree.route(sample) for row in found.tolist() if home.all()]
        assert sorted(row for _, row in placed) == list(range(len(rows)))
    root = {bytes(r.a): bytes(r.b) for r in simhash.wide_classes(prints, shard_rows=64).collect()}
    together = [root.get(a, a) == root.get(b, b) for a, b in partner.items()]
    assert np.mean(together) >= 0.99
    # 700 pairs and few chance links
    assert len(root) <= 710


def test_the_stage_asks_the_trees_and_leaves_one_table(spark, monkeypatch):
    asked, search = [], simhash.wide_classes

    def spied(prints):
        asked.append(prints.count())
        return search(prints)

    monkeypatch.setattr(simhash, "wide_classes", spied)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(reversed(words))), (4, "a b")], "doc_id long, text string")
    folder = run_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = likeness.first_of_each_group(docs)
    left = set(os.listdir(folder)) - before
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4] and asked == [3]
    assert len(left) == 1 and left.pop().startswith("kept-")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
