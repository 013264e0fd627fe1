"""Periodic runs against a comparison of all words at all distances."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lotlens.llm import catalog, periodic


def slow_runs(words):
    best = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                best.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def slow_row(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(slow_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = [hashlib.sha256(x).hexdigest() for x in (
        "".join(f"{s},{n},{q}\n" for s, n, q in found).encode(), b" ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc_id, len(found), *top, *digest)


def cases():
    draw = random.Random(5)
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    thue = "".join(str(bin(i).count("1") % 2) for i in range(400))
    out = [list(fib[-1][:700]), list(thue * 3), ["x"] * 300, list("ab" * 12), list("ab" * 12 + "a"), list("abc" * 7 + "ab"), list("abcdefghi" * 3), list("abcdefghi" * 3)[:-1]]
    for q in (*range(1, 40), 53, 81, 82, 121, 122, 200, 333):
        period = [str(draw.randrange(1 + draw.choice((1, 3, 50)))) for _ in range(q)]
        size = max(24, 3 * q) + draw.choice((-1, 0, 1, q // 2, 5 * q))
        run = [period[i % q] for i in range(size)]
        out.append([f"l{draw.randrange(9)}" for _ in range(draw.randrange(30))] + run + [f"r{draw.randrange(9)}" for _ in range(draw.randrange(30))])
        out.append(run + run[: draw.randrange(len(run))] + run)
    for _ in range(60):
        out.append([draw.choice("ab") for _ in range(draw.randrange(300))])
        block = [draw.choice("abcde") for _ in range(draw.randrange(1, 60))]
        noisy = block * draw.randrange(2, 9)
        for _ in range(draw.randrange(3)):
            noisy[draw.randrange(len(noisy))] = "z"
        out.append(noisy)
    return out


def test_all_runs_of_odd_sequences():
    texts = cases()
    number = periodic.Numbers().__getitem__
    got = periodic.find_runs([np.array([number(w) for w in t], dtype=np.int64) for t in texts])
    for text, found in zip(texts, got, strict=True):
        assert found == slow_runs(text), "".join(text)[:200]
    assert sum(map(len, got)) > 100


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.op12_periodic_runs(spark, sf).collect())
    # the slow search takes the shorter texts; the long ones follow below
    slow = {r.doc_id: slow_row(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 1500}
    assert len(slow) > 150 and [r for r in got if r[0] in slow] == [slow[r[0]] for r in got if r[0] in slow]
    assert len(got) == docs.count() and sum(r[1] > 0 for r in got) > 10


def test_long_texts(spark):
    draw = random.Random(6)
    rows, expected = [], []
    for n, q in enumerate((1, 3, 100, 4_001, 30_000)):
        period = [f"w{draw.randrange(2000)}" for _ in range(q - 1)] + ["end"]
        run = (period * (2 + 120_000 // q))[:120_000]
        rows.append((n, " ".join(["left"] * (n % 2) + run + ["right"])))
        expected.append((n, [(n % 2, 120_000, q)], n % 2 + q + 1))
    got = periodic.runs(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs], len(r.collapsed.split(" "))) for r in got] == expected


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (1, ""), (2, " \t\n"), (None, "a " * 50), (3, "é ß " * 30)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS start", "'x' AS `a.b`")
    got = sorted(map(tuple, periodic.summary(periodic.runs(docs)).collect()), key=repr)

    def plain(doc_id, text):
        return (doc_id, *slow_row(None, text)[1:])

    assert got == sorted((plain(*r) for r in rows), key=repr)
