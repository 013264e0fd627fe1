"""Near-duplicates of the pipeline against the likeness of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotlens.llm import likeness, simhash
from test_llm_operators import ODD, SCHEMA, words


def shingle_set(text):
    found = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def alike(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def slow_firsts(rows):
    """Smallest ids of the components of all pairs of likeness 0.8 or more."""
    sets = sorted({shingle_set(t) for _, t in rows}, key=lambda s: sorted(s))
    a, b = zip(*[(i, j) for i in range(len(sets)) for j in range(i + 1) if alike(sets[i], sets[j])], strict=True)
    root = dict(zip(sets, simhash.components(len(sets), np.array(a), np.array(b)).tolist(), strict=True))
    first = {}
    for doc_id, text in rows:
        k = root[shingle_set(text)]
        first[k] = min(first.get(k, doc_id), doc_id)
    return set(first.values())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_stage_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.one_of_each_group(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(slow_firsts([(r.doc_id, r.text) for r in docs.collect()]))


def test_edited_copies_and_a_shared_passage(spark):
    """Chains of edited copies of all sizes, near the bound, beside texts that share a passage only."""
    draw = random.Random(8)
    word = lambda: f"w{draw.randrange(10**6)}"
    passage, rows = [word() for _ in range(40)], []
    for size in [*range(0, 14), 20, 33, 60, 120, 400]:
        for _ in range(3):
            text = [word() for _ in range(size)]
            for _ in range(5):
                rows.append(" ".join(text))
                for _ in range(draw.randrange(1, 2 + size // 40)):
                    text = text[: draw.randrange(len(text) + 1)] + [word()] + text[draw.randrange(1, 4) :] if draw.random() < 0.2 else [*text, word()] if draw.random() < 0.5 else [w if i != len(text) // 2 else word() for i, w in enumerate(text)]
    for _ in range(60):
        rows.append(" ".join(passage + [word() for _ in range(draw.randrange(4, 60))]))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in likeness.first_of_each_group(docs).collect())
    assert got == sorted(slow_firsts(rows)) and len(got) < len(rows) - 20


def test_partners_share_a_bucket_and_have_near_sketches():
    draw, met, all_ = np.random.default_rng(4), 0, 0
    for size in [*range(4, 80), 150, 700, 5000]:
        for _ in range(20):
            a = draw.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
            # (size - k) / (size + more) of likeness 0.8 at least
            k = int(draw.integers(0, size // 5 + 1))
            more = max(0, int((size - k) * 5 // 4) - size)
            b = np.concatenate([a[k:], draw.integers(0, 2**63, more, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            assert len(np.intersect1d(a, b)) * 5 >= 4 * len(np.union1d(a, b))
            x, y = likeness.sketch(a).view(np.uint64), likeness.sketch(b).view(np.uint64)
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            y = y if len(x) == len(y) else y[: len(x)] ^ y[len(x) :]
            assert 9 * np.bitwise_count(x ^ y).sum() <= len(a) + len(b)
            all_ += 1
            met += len(np.intersect1d(likeness.bands(likeness.min_hashes(a)), likeness.bands(likeness.min_hashes(b)))) > 0
    assert met >= 0.998 * all_


@pytest.mark.parametrize("limits", [{}, {"CELL": 16, "HUB": 5, "SALTS": 3, "HOT": 20}])
def test_groups_around_a_text_and_of_one_template(spark, monkeypatch, limits):
    """Copies near to one text but not to each other, a template that fills three quarters of unlike texts, and many equal texts."""
    for name, value in limits.items():
        monkeypatch.setattr(likeness, name, value)
    draw = random.Random(9)
    word = lambda: f"w{draw.randrange(10**6)}"
    center, template, rows = [word() for _ in range(300)], [word() for _ in range(150)], []
    for _ in range(80):
        text = list(center)
        for _ in range(draw.randrange(3, 8)):
            text[draw.randrange(300)] = word()
        rows.append(" ".join(text))
    rows.append(" ".join(center))
    rows += [" ".join(template + [word() for _ in range(50)]) for _ in range(60)]
    rows += ["one text that many rows hold and some more words"] * 50
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in likeness.first_of_each_group(docs).collect())
    assert got == sorted(slow_firsts(rows)) and 60 < len(got) < 110


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    for name in ("fp", "k", "l", "doc", "rest", "key", "a.b"):
        odd = odd.withColumn(name, F.lit("clash"))
    got = likeness.first_of_each_group(odd).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 2, 4, 6, 7] and len(got) == 6
    assert likeness.first_of_each_group(odd.limit(0)).count() == 0
