"""The pipeline stage by stage against brute force, and whole."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lotlens.llm import decontaminate, mixing
from lotlens.session import stored
from test_likeness import slow_firsts


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs = stored(stage(spark, docs, sf), name)
    rows = {n: [tuple(r) for r in d.collect()] for n, d in seen.items()}
    whole = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert all(seen[n].columns == ["doc_id", "text", "lang", "source", "n_chars"] for n in list(seen)[:-1])
    assert Counter(rows["language"]) == Counter(r for r in whole if any(c.isalpha() for c in r[1] or ""))

    assert sorted(r[0] for r in rows["near_duplicates"]) == sorted(slow_firsts([(r[0], r[1]) for r in rows["language"]]))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    block = decontaminate.Benchmark(items, decontaminate.SEED)
    assert {r[0] for r in rows["benchmark"]} == {r[0] for r in rows["near_duplicates"] if not list(block.leaks(r[1], 0.8))}

    mix = mixing.mix(seen["benchmark"], mixing.label_quality(spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    assert Counter(r[0] for r in rows["mix"]) == +Counter({r.doc_id: r.taken // r.size for r in mix})

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, expected = 0, []
    for doc_id, text in sorted((r[0], r[1]) for r in rows["mix"]):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows["tokens"], key=lambda r: r[1]) == expected
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[1]) == expected
