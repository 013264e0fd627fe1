"""Quality rules against plain Python, and their threshold."""

import math
import random
import re
from collections import Counter
from hashlib import md5

import pytest

from lotlens.llm import catalog, quality

LABELS = "doc_id long, quality int, toxic int"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(text):
    h = [int(md5(w.encode()).hexdigest()[:8], 16) for w in split(text)]
    return [x % quality.BUCKETS for x in h] + [(31 * x + y) % quality.BUCKETS for x, y in zip(h, h[1:], strict=False)]


def slow_rules(text):
    words, text = split(text), text or ""
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    held = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if split(line)]
    failed = len(words) < 50 or 100 * len(held) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(line in lines[:i] for i, line in enumerate(lines)), len(held), failed


def slow(docs, labels, loss=quality.LOSS):
    seen = {}
    for i, q, t in labels:
        seen.setdefault(i, []).append((q, t))
    good = {i for i, marks in seen.items() if i is not None and {q for q, _ in marks} - {None} == {1} and not any(t for _, t in marks)}
    count = {i for i in good if md5(str(i).encode()).hexdigest() < "8"}
    raw, target = Counter(), Counter()
    for i, text in docs:
        raw.update(grams(text))
        if i in count:
            target.update(grams(text))
    n, t = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    weight = {b: round(quality.MICRO * (math.log((target[b] + 1) / t) - math.log((raw[b] + 1) / n))) for b in raw}
    rows = [(i, *slow_rules(text), sum(map(weight.get, g)) // len(g) if (g := grams(text)) else None) for i, text in docs]
    held = sorted(r[7] for r in rows if r[0] in good - count and not r[6])
    least = held[int(loss * len(held))] if held else -math.inf
    return sorted(((r[0], *r[1:6], r[7], r[6], not r[6] and r[7] >= least) for r in rows), key=repr)


def result(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept").collect()), key=repr)


def test_registered_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert result(catalog.op13_ratio_quality(spark, sf)) == slow(docs, labels)


def test_verdicts_on_labelled_documents(spark):
    root = "/root/testdata/sf0.01"
    rows = catalog.op13_ratio_quality(spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and len(good) > 200
    assert sum(bad) <= 0.35 * len(bad) and len(bad) > 20


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, labelled):
    draw = random.Random(8)
    words = [f"w{i}é" for i in range(40)]
    docs = [(i, " ".join(draw.choice(words if i % 4 else ["#", "<b>", "$", "w1é"]) for _ in range(draw.randrange(40, 90)))) for i in range(200)]
    docs += [(7, "same line\nsame line\n\n \t\n\nsame line"), (7, "same line\nsame line\n\n \t\n\nsame line"), (None, "null id " * 60), (None, None), (300, None), (301, ""), (302, " \t\x0b\n"),
             (303, "a b c d a b c"), (304, "a a a a a"), (305, "one word  x"), (306, "lorem ipsum dolor " * 30_000)]
    labels = [(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(150)] if labelled else []
    labels += [(3, 0, 0), (5, 1, 0), (5, 1, None), (6, None, 1), (None, 1, 0), (999, 1, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS kept", "'x' AS `a.b`")
    marks = spark.createDataFrame(labels, LABELS).selectExpr("*", "1 AS text", "2 AS good")
    for loss in (quality.LOSS, 0.1):
        assert result(quality.verdicts(frame, marks, loss)) == slow(docs, labels, loss)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], LABELS)
    assert quality.verdicts(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "word " * 20 + " ".join(map(str, range(60))))], "doc_id long, text string")
    assert [r.kept for r in quality.verdicts(one, labels).collect()] == [True]


def test_all_trusted_documents_count_and_the_threshold_is_exact(spark):
    """More trusted ids than the former bound of 100,000; scores in few and many steps."""
    labels = spark.range(120_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality.trusted_ids(labels).count() == 120_000
    for spread, loss in ((1, 0.0), (1, 0.25), (7_919, 0.001), (7_919, 0.5)):
        scores = [i * spread % 10_007 - 4_000 for i in range(3_000)]
        got = quality.threshold(spark.createDataFrame([(x,) for x in scores], "score long"), loss)
        assert got == sorted(scores)[int(loss * len(scores))]
    assert quality.threshold(spark.createDataFrame([], "score long"), 0.5) is None
