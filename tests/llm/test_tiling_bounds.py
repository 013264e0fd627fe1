"""Tiling: items that share an opening only, repeated seeds, blocks written one by one."""

import random
import time
from collections import Counter

import numpy as np

from lotlens.llm import decontaminate as D

OPENING = "answer the following question in one short sentence please"


def slow_leaks(items, text, seed, coverage):
    """Every item tiled with the whole text, no seeds."""
    code = {w: k for k, w in enumerate(dict.fromkeys(D.words(" ".join([text, *items]))), 1)}
    out = []
    for number, item in enumerate(items):
        a, b = (np.array([code[w] for w in D.words(t)], dtype=np.uint64) for t in (item, text))
        covered = sum(n for _, _, n in D.greedy_tiles(a, b, min(seed, len(a)))) if len(a) else 0
        if len(a) and covered >= coverage * len(a):
            out.append((number, covered))
    return out


def test_skipped_items_do_not_reach_the_coverage():
    draw = random.Random(3)
    for _ in range(200):
        items = [" ".join(draw.choice("abc") for _ in range(draw.randrange(0, 14))) for _ in range(6)]
        text = " ".join(draw.choice("abcd") for _ in range(draw.randrange(0, 60)))
        for coverage in (0.4, 0.8, 1.0):
            got = [(i, covered) for i, _, _, covered, _ in D.Benchmark(list(enumerate(items)), 3).leaks(text, coverage)]
            assert got == slow_leaks(items, text, 3, coverage)


def test_items_of_one_opening_cost_no_tiling():
    draw = random.Random(5)
    items = [(n, OPENING + " " + " ".join(f"w{draw.randrange(50_000)}" for _ in range(40))) for n in range(5000)]
    block = D.Benchmark(items, D.SEED)
    start = time.process_time()
    assert not list(block.leaks(f"Intro. {OPENING}. " * 300, D.COVERAGE))
    assert [leak[0] for leak in block.leaks(f"{OPENING}. " * 300 + items[77][1], D.COVERAGE)] == [77]
    assert time.process_time() - start < 2


def test_blocks_by_items_and_bytes(spark, monkeypatch):
    draw = random.Random(9)
    items = [(n, " ".join(f"w{draw.randrange(3000)}" for _ in range(30))) for n in range(40)] + [(3, "w1 w2 w3 w4 w5 w6")] * 3 + [(None, None)]
    rows = [(n, f"pre {items[n][1]} post" if n % 3 else "clean text") for n in range(40)] + [(50, "w1 w2 w3 w4 w5 w6"), (None, None)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    whole = Counter(map(tuple, D.leaks(docs, bench).collect()))
    kept = Counter(map(tuple, D.clean(docs, bench).collect()))
    assert whole and sum(k[0] == 50 for k in whole.elements()) == 3 and len(kept) == 42 - len({k[0] for k in whole})
    monkeypatch.setattr(D, "BLOCK_BYTES", 1500)
    assert Counter(map(tuple, D.leaks(docs, bench).collect())) == whole and Counter(map(tuple, D.clean(docs, bench).collect())) == kept
