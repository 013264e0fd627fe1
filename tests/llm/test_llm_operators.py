"""Each operator against a brute-force version, and on nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotlens.llm import chat, decontaminate, langid, licenses, mixing, multiset, sharding, simhash, site_lines, token_files
from lotlens.session import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (1, "one two three four five.\nSix seven, eight nine ten. Eleven", "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0),
    (3, "", None, None, 0), (4, "a  b\t\n c \x0b d", "en", "b", 1), (None, "no id at all", "en", "b", 3), (None, None, None, None, None),
    (6, LONG, "en", "c", 9), (7, "éß İx 你好 Ǆ", "de", "c", 9), (8, "one two three four five.\nSix seven, eight nine ten. Eleven", "en", "a", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Strange rows, with extra columns of the names that the operators give."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    for name in ("size", "shard", "key", "fp", "component_id", "target", "copies", "held_out", "score", "part", "row_key", "h", "place"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# chat


def turns_of(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in by.items()}


def test_chat_round_trip(spark):
    end = chat.END
    texts = ["", None, r"\### Assistant: </turn> ok", "\n</turn>\n### assistant:\nhi", "\\", "a\\", "</turn>", "\n</turn>", "### ", "###", "\\\\</turn>", "x\n</turn>\n", LONG, "plain # text </turn"]
    rows = [(c, i, role, t) for c, role in ((1, "user"), (2, "assistant"), (None, "a\n\\b:"), (5, None)) for i, t in enumerate(texts)]
    rows += [(9, None, "user", "no turn"), (9, 3, "assistant", "b"), (9, 3, "assistant", "a"), (9, 3, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(frame)).collect()}
    assert set(got) == {1, 2, None, 5, 9}
    for conv, expected in turns_of(rows).items():
        if conv == 9:
            expected = [("user", "no turn"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
        loss = "".join(t for r, t in expected if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(expected)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in expected).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.formatted_chars == sum(len(chat.render_turn(r, t)[0]) for r, t in expected)
    assert chat.render_turn("user", "plain </turn text")[0] == f"### user:\nplain </turn text\n{end}\n"
    assert chat.read_conversations(chat.format_conversations(frame.limit(0))).count() == 0


def test_chat_parser_on_random_texts():
    draw = random.Random(3)
    parts = ["\\", "### ", "</turn>", "\n", "a", ":", "user", " "]
    for _ in range(500):
        turns = [("".join(draw.choices(parts, k=2)), "".join(draw.choices(parts, k=draw.randrange(9)))) for _ in range(3)]
        assert chat.parse("".join(chat.render_turn(*t)[0] for t in turns)) == turns
    for broken in ("### user:\nabc", "user:\nabc\n</turn>\n", "### user:\na ### b\n</turn>\n"):
        with pytest.raises(chat.Conflict):
            chat.parse(broken)


# token files


def check_tokens(spark, frame, rows):
    folder, path = scratch(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")
    token_files.write(frame, folder, path)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in rows))
    got = sorted((r.start, r.n_tokens, r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in token_files.read(spark, folder).collect())
    ids = [e.ids + [0] for e in library.encode_batch([r[2] for r in rows], add_special_tokens=False)]
    assert [g[2:4] for g in got] == [r[:2] for r in rows]
    assert [g[0] for g in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    # rows of one id go by a hash of the text
    assert Counter(g[1:] for g in got) == Counter((len(i), *r[:2], zlib.crc32(np.array(i, "<u4").tobytes())) for i, r in zip(ids, rows, strict=True)) or len({r[:2] for r in rows}) < len(rows)


def test_token_files(spark, docs, odd, none):
    check_tokens(spark, docs, docs.collect())
    unique = odd.filter("doc_id is not null and doc_id <> 3")
    check_tokens(spark, unique, unique.collect())
    folder = scratch(spark, "tokens")
    token_files.write(odd, folder, public_tokenizers.path("byte_bpe_50k.json"))
    back = token_files.read(spark, folder).collect()
    assert Counter(r.doc_id for r in back) == Counter(r[0] for r in ODD)
    assert min(back, key=lambda r: r.start).doc_id is None
    folder = scratch(spark, "tokens")
    assert token_files.write(none, folder, public_tokenizers.path("byte_bpe_50k.json"))["parts"] == []
    assert token_files.read(spark, folder).count() == 0


def test_encoder_equals_the_library():
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), kept=5)
    assert encoder.by_word
    draw = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "it's", "12", "!?", "é", "你", "\0", " ", " ", "<|endoftext|>", "word"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(400)]
    for text, one in zip(texts, encoder.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == np.array(one.ids + [0], "<u2").tobytes()


# languages


def test_languages(spark, sf, none):
    docs = spark.read.parquet(sf.replace("0.001", "0.1") + "/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    model = langid.fit(docs)
    got = langid.languages(docs, model).collect()
    assert len(got) == len(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out and known[r.doc_id]]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in tested]) > 0.98
    assert sum(r.rejected for r in got) == 0
    strange = ["Съешь же ещё этих мягких французских булок, да выпей чаю. " * 6, "12 !?", "", None, "x"]
    assert [p[2] for p in model.predict(strange)] == [True, True, True, True, False]
    assert [p[0] for p in model.predict(strange)][1:4] == ["und"] * 3


def test_languages_of_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.lang_pred) for r in langid.languages(odd).collect()}
    assert (2, "und") in got and (3, "und") in got and (None, "und") in got and langid.languages(odd).count() == len(ODD)
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and kept.filter("text is null or text = ''").count() == 0
    assert langid.languages(none).count() == 0 and langid.accepted(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.languages(unlabelled).collect()} == {"und"}


def test_ngram_counts_in_pieces(monkeypatch):
    text = "Ab  cd, éÉ. 12 x" * 40
    whole = langid.counts(text)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "PIECE", size)
        assert (langid.counts(text) == whole).all()


# multiset hash


def check_edits(rows, got):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    got = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256))
    expected = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        new = text[: len(text) - k] + following[:k]
        a, b, c = (multiset.fingerprint(t) for t in (text, new, following))
        expected.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), a.likeness(b), a.likeness(c)))
    expected.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [tuple(r) for r in got] == expected


def test_multiset_edits(spark, docs, odd, none):
    check_edits([(r.doc_id, r.text) for r in docs.collect()], multiset.with_edits(docs.repartition(7)).collect())
    check_edits([r[:2] for r in ODD], multiset.with_edits(odd).collect())
    check_edits([r[:2] for r in ODD[:1]], multiset.with_edits(odd.limit(1)).collect())
    no_ids = odd.filter("doc_id is null")
    check_edits([r[:2] for r in ODD if r[0] is None], multiset.with_edits(no_ids).collect())
    assert multiset.with_edits(none).count() == 0


def test_multiset_algebra():
    draw = random.Random(2)
    parts = [f"line {draw.randrange(10**6)} of it" for _ in range(80)]
    whole = multiset.fingerprint("\n".join(parts))
    assert whole.hex() == multiset.fingerprint("\n".join(reversed(parts))).hex()
    assert (whole - multiset.fingerprint(parts[3]) + multiset.fingerprint("new")).hex() == multiset.fingerprint("\n".join(parts[:3] + parts[4:] + ["new"])).hex()
    assert (whole + multiset.fingerprint(parts[0])).hex() != whole.hex()
    half = multiset.fingerprint("\n".join(parts[:40] + [f"other {i}" for i in range(40)]))
    assert 0.3 < whole.likeness(half) < 0.7 and whole.likeness(whole) == 1
    assert multiset.fingerprint("").likeness(whole) == 0 and multiset.fingerprint("").likeness(multiset.fingerprint("\n")) == 1


# string tiling


def slow_tiles(item, text, least):
    """Greedy tiling by definition: the longest free common run, again and again."""
    in_item, in_text, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in in_item and j + n not in in_text:
                    n += 1
                if n > best[2]:
                    best = i, j, n
        if best[2] < least:
            return tiles
        i, j, n = best
        in_item |= set(range(i, i + n))
        in_text |= set(range(j, j + n))
        tiles.append(best)


def test_tiles_equal_the_definition():
    draw = random.Random(7)
    for _ in range(150):
        item = np.array([draw.randrange(1, 5) for _ in range(draw.randrange(1, 25))], dtype=np.uint64)
        text = np.array([draw.randrange(0, 5) for _ in range(draw.randrange(0, 40))], dtype=np.uint64)
        fast = decontaminate.greedy_tiles(item, text, 3)
        assert Counter(t[2] for t in fast) == Counter(t[2] for t in slow_tiles(list(item), list(text), 3))


def test_leaks(spark, docs, sf, odd, none):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: decontaminate.words(r.text) for r in bench.collect()}
    expected = set()
    for r in docs.collect():
        found = decontaminate.words(r.text)
        shingles = {tuple(found[i : i + 5]) for i in range(len(found) - 4)}
        for item_id, item in items.items():
            if any(tuple(item[i : i + 5]) in shingles for i in range(len(item) - 4)):
                names = {w: k for k, w in enumerate(dict.fromkeys(item), 1)}
                near = [names.get(w, 0) for w in found]
                covered = sum(t[2] for t in slow_tiles([names[w] for w in item], [x if x else -k for k, x in enumerate(near)], 5)) if len(found) < 600 else None
                if covered is None or covered >= 0.8 * len(item):
                    expected.add((r.doc_id, item_id, covered))
    got = {(r.doc_id, r.item_id, r.covered) for r in decontaminate.leaks(docs, bench).collect()}
    assert {e[:2] for e in expected if e[2]} <= {g[:2] for g in got} <= {e[:2] for e in expected}
    assert {e for e in expected if e[2]} <= got
    assert decontaminate.clean(docs, bench).count() == docs.count() - len({g[0] for g in got})


def test_leaks_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([
        (1, "five six seven eight nine ten one two three four"), (2, None), (3, ""), (4, "d c"), (5, "no ID"), (5, "no ID"), (None, "zzz")], "item_id long, text string")
    reordered = spark.createDataFrame([(1, "Eight nine ten one, two -- THREE four! and then five six seven eight."), (2, "five six seven eight"), (3, "here is no id")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.covered) for r in decontaminate.leaks(reordered, bench).collect())
    assert (3, 5, 2) in got and got.count((3, 5, 2)) == 2 and (2, 1, 4) not in got
    parts = spark.createDataFrame([(1, "five six seven eight nine x one two three four five six. ten")], "doc_id long, text string")
    shuffled = spark.createDataFrame([(1, "f g h i j k l a b c d e")], "item_id long, text string")
    moved = spark.createDataFrame([(9, "so: a b c d e! then, f g h i j k l.")], "doc_id long, text string")
    assert [(r.covered, r.n_tiles) for r in decontaminate.leaks(moved, shuffled).collect()] == [(12, 2)]
    assert decontaminate.leaks(parts, shuffled).count() == 0
    assert decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.clean(odd, bench.limit(0)).count() == len(ODD) and decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.leaks(none, bench).count() == 0


def test_blocks_of_the_benchmark(spark, docs, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == whole


# simhash


def slow_print(text):
    found = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + 3]), 42) for i in range(max(1, len(found) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(values, radius=2):
    values = np.array(sorted(set(values)), dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
    return dict(zip(values.tolist(), values[simhash.components(len(values), a, b)].tolist(), strict=True))


def check_duplicates(rows, got):
    prints = [(i, slow_print(t)) for i, t in rows]
    root = slow_classes([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{p:016x}", least.get(root[p])) for i, p in prints)


def test_near_duplicates(spark, docs, odd, none):
    check_duplicates([(r.doc_id, r.text) for r in docs.collect()], simhash.near_duplicates(docs).collect())
    check_duplicates([r[:2] for r in ODD], simhash.near_duplicates(odd).collect())
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.first_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id, (r.text or "")[:9]) for r in kept.filter("doc_id is not null").collect()) == [(1, "one two t"), (2, ""), (4, "a  b\t\n c "), (6, "lorem ips"), (7, "éß İx 你好 ")]
    twice = odd.filter("doc_id = 1").union(odd.filter("doc_id = 1"))
    assert simhash.first_of_each_group(twice).count() == 1 and simhash.first_of_each_group(none).count() == 0


def planted(count, seed=1):
    draw = np.random.default_rng(seed)
    values = draw.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2)
    near = values[: count // 4].copy()
    for _ in range(3):
        near ^= np.uint64(1) << draw.integers(0, 64, len(near), dtype=np.uint64)
    dense = values[0] ^ (np.uint64(1) << draw.integers(0, 64, count // 4, dtype=np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, count // 4, dtype=np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, count // 4, dtype=np.uint64))
    return np.unique(np.concatenate([values, near, dense, np.array([0, 1, 2**64 - 1], dtype=np.uint64)]))


@pytest.mark.parametrize(("radius", "blocks", "shard"), [(2, None, 60), (2, 1, 400), (1, None, 100), (3, None, 50), (2, None, 10**6)])
def test_trees_find_every_link(radius, blocks, shard):
    """Routing to overlapping shards and local trees against all pairs."""
    values = planted(3000)
    edges = []
    for tree in simhash.forest(values[::2], len(values), radius, blocks, shard):
        shards = {}
        for number, rows, home in tree.route(values):
            shards.setdefault(number, ([], []))
            shards[number][0].append(values[rows[home]])
            shards[number][1].append(values[rows[~home]])
        assert sum(len(x) for own, _ in shards.values() for x in own) == len(values)
        edges += [simhash.local_links(np.concatenate(own), np.concatenate(others), radius, leaf=16) for own, others in shards.values()]
    a, b = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    label = simhash.components(len(values), np.searchsorted(values, a), np.searchsorted(values, b))
    expected = slow_classes(values.tolist(), radius)
    assert values[label].tolist() == [expected[v] for v in values.tolist()]


def test_roots_of_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300)]
    got = dict(tuple(r) for r in simhash.roots(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 150: 100}


# site lines


def test_site_lines(spark):
    pages = [(i, f"https://{'Hot' if i % 2 else 'b'}.org:80/p{i}", f"<div>menu</div><p>text {i} <b>bold</b></p><script>x('<p>')</script><p>rare {i // 5}</p><li>menu</li>") for i in range(40)]
    pages += [(100, None, "<p>menu</p>"), (101, "nonsense", "menu"), (102, "http://b.org/x", None), (102, "http://b.org/x", None), (None, "http://few.org", "one<br>two")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lines", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = site_lines.drop_site_lines(site_lines.html_pages(frame)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(pages)
    assert by[1].host == "hot.org" and by[1].n_lines == 4 and by[1].n_dropped == 2 and by[1].text == "text 1 bold\nrare 0"
    assert by[100].text == "menu" and by[101].host is None and by[102].text == "" and by[None].text == "one\ntwo"
    assert site_lines.drop_site_lines(site_lines.html_pages(frame.limit(0))).count() == 0


# mixing


def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            rest -= target[s]
        open_ -= over
    return target


def test_mix(spark, docs, sf, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for frame, quality in ((docs, mixing.label_quality(labels)), (docs.withColumn("source", F.expr("case when doc_id % 3 = 0 then 'hot' when doc_id % 50 = 1 then null else source end")), None)):
        rows = {r.doc_id: r for r in frame.collect()}
        got = mixing.mix(frame, quality).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(frame.repartition(5), quality).collect()))
        sizes = Counter()
        for r in rows.values():
            sizes[r.source] += len(words(r.text))
        target = slow_targets(sizes)
        taken, largest = Counter(), Counter()
        for r in got:
            source = rows[r.doc_id].source
            assert r.size == len(words(rows[r.doc_id].text)) and r.source_size == sizes[source]
            assert r.target == pytest.approx(target[source]) and r.taken <= 3 * r.size
            taken[source] += r.taken
            largest[source] = max(largest[source], r.size)
        assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)
        copies = Counter({r.doc_id: r.taken // r.size for r in got if r.size})
        again = Counter(r.doc_id for r in mixing.mixed_documents(frame, quality).collect() if words(r.text))
        assert again == +copies


def test_mix_takes_the_smallest_keys(spark):
    frame = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i < 400 else "b") for i in range(800)], "doc_id long, text string, source string")
    units = {r.doc_id: r.key for r in mixing.unit_rows(frame).collect()}
    got = {r.doc_id: (r.taken, r.size) for r in mixing.mix(frame).collect()}
    for part in (range(400), range(400, 800)):
        copies = [got[i][0] // got[i][1] for i in sorted(part, key=units.get)]
        assert copies == sorted(copies, reverse=True)


def test_mix_of_odd_rows(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mix(odd.filter("text is null")).collect())


def test_better_documents_come_earlier(spark):
    frame = spark.createDataFrame([(i, "a b c", "s" if i < 3000 else "t") for i in range(4000)], "doc_id long, text string, source string")
    quality = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(0.25).alias("quality"))
    share = mixing.mix(frame, quality, weights=(1, 3)).filter("doc_id < 3000").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()
    by = {r.odd: r.n for r in share}
    assert by[0] > 2 * by[1]


# licenses


def test_license_scan(spark, docs, odd, none):
    expected = set()
    for r in docs.collect():
        found = licenses.words(r.text)
        shingles = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        for name, template in licenses.TEMPLATES:
            t = licenses.words(template)
            wanted = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            size = len(t) - 4
            if any(len(wanted & set(shingles[i : i + size])) >= 0.8 * len(wanted) for i in range(max(1, len(shingles) - size + 1))):
                expected.add((r.doc_id, name))
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert got == expected and got
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_license_with_changes(spark):
    draw = random.Random(4)
    rows = []
    for k, (_, template) in enumerate(licenses.TEMPLATES):
        t = template.split()
        rows.append((k, " ".join(["xx"] * draw.randrange(90) + t + ["yy"] * draw.randrange(90))))
        if len(t) > 30:
            t[draw.randrange(len(t))] = "changed"
            rows.append((k, " ".join(["xx"] * draw.randrange(90) + t).upper()))
    rows += [(99, "Permission is hereby granted to nobody. " * 30)]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k, licenses.TEMPLATES[k][0]) for k, _ in rows if k != 99} <= got and not any(d == 99 for d, _ in got)
    assert licenses.retrieval_probability(licenses.least_jaccard()) > 0.9999


# shards


def test_shards(spark, docs, odd, none):
    for frame in (docs, odd):
        rows = frame.collect()
        got = sorted(sharding.shards(frame).collect(), key=lambda r: (r.shard, r.slot))
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
        order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert order == sorted(order)
        for shard in {r.shard for r in got}:
            assert [r.slot for r in got if r.shard == shard] == list(range(sum(r.shard == shard for r in got)))
        total, largest, at = sum(r.size for r in got), max(r.size for r in got), 0
        for r in got:
            assert abs((at + r.size / 2) * 8 / total - r.shard - 0.5) <= 0.5 and r.law == "bytes" and r.grown_shard is None
            at += r.size
        held = Counter()
        for r in got:
            held[r.shard] += r.size
        assert all(abs(held[s] - total / 8) <= largest for s in range(8))
    assert sharding.shards(none).count() == 0


def test_equal_rows_fall_into_several_ranges(spark, monkeypatch):
    rows, kept, write = spark.range(8_000).select(F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id")).alias("doc_id"), F.lit(5).cast("long").alias("size")).repartition(6), {}, sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda df, name: kept.setdefault(name, write(df, name)))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sharding.with_prefix_sums(rows, ["doc_id", "size"], "size").orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    parts = [r["count"] for r in kept["ranged"].groupBy("part").count().collect()]
    assert len(parts) == 4 and max(parts) <= 3_000
    assert [r["rank"] for r in got] == list(range(8_000)) and [r.before for r in got] == [5 * i for i in range(8_000)]
