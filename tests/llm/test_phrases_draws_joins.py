"""Collocations, importance resampling and the n-gram join against plain versions, and the helpers under them."""

import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from assaylane.llm import bitmaps, collocations, components, importance, linking, near, ngram_join, radix
from assaylane.llm import words as arrays

SCHEMA = "doc_id long, text string, lang string, phrase string, score long, rank long, n long, key string, component_id long"


def prose(seed, n, vocabulary=2_000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, rows):
    """Rows of (doc_id, text, lang), next to columns named like results."""
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, 3, "k", 4) for i, t, lang in rows], SCHEMA).repartition(3)


def common_rows():
    long = prose(7, 40_000)
    return [
        (1, "New York is big. New York, the New York!", "en"), (2, None, "en"), (3, "", None), (4, "a", None), (5, " .,; \n", "fr"),
        (6, long, "en"), (7, "x" * 5_000 + " " + "é" * 700, "de"), (8, prose(8, 60), "en"), (8, prose(8, 60), "en"), (None, prose(8, 60), "und"),
        (None, None, None), (9, "Été 日本 été 日本 été 日本", "fr"), (10, prose(8, 59) + " other", "en"), (11, "a b c", "en"), (12, "A B c", "en"),
    ]


def test_word_arrays():
    rng = random.Random(3)
    alphabet = [*"aétx12 .,'\n\t  Zé日😀!\x0b", "x" * 300, "longer-word", "y" * 256, "z" * 257]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(800)] + [None, ""]
    for inside, pattern in ((arrays.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (arrays.NOT_SPACE, r"[^\x20\x09-\x0D]+")):
        found = arrays.find_words(pa.array(texts).slice(5), inside)
        numbers, crcs, seen = arrays.word_numbers(found), list(arrays.run_crcs(found, 3)), {}
        for i, text in enumerate(texts[5:]):
            want = re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            a, b = found.first[i], found.first[i + 1]
            assert [found.word(j).decode() for j in range(a, b)] == want
            for j in range(a, b):
                assert seen.setdefault(want[j - a], numbers[j]) == numbers[j]
                for n in (1, 2, 3):
                    if j + n <= b:
                        assert crcs[n - 1][j] == zlib.crc32(" ".join(want[j - a : j - a + n]).encode())
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("limits", [{"least": 3, "best": 40}, {"least": 2, "range_rows": 40, "part_bytes": 20_000}, {"least": 2, "longest": 3}])
def test_collocations(spark, limits):
    rng = random.Random(4)
    pieces = ["the", "of", "New", "york", "a", "b", "c", "été", "x!y", "日本", "z" * 300]
    glue = [" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(glue) for _ in range(rng.randrange(80))), rng.choice(["en", "fr", None, "und"])) for i in range(300)]
    rows += common_rows() + [(0, "one two three four five six seven", "es")] * 20
    plain = {k: v for k, v in limits.items() if k in ("least", "best", "longest")}
    want = Counter(collocations.brute_force([(lang, t) for _, t, lang in rows], **plain))
    found = collocations.collocations(table(spark, rows), **limits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(map(tuple, found.collect())) == want and len(want) > 30


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark, common_rows()).where("false")).collect() == []
    assert collocations.collocations(table(spark, common_rows()), least=10**6).collect() == []


def lettered(n_words, vocabulary, seed, rows=50):
    """A batch of ``n_words`` words of a few letters."""
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, vocabulary, n_words // rows)) for _ in range(rows)]
    return pa.record_batch([pa.array(texts), pa.array(["en"] * rows)], names=["text", "lang"])


def every(numbers):
    return np.ones(len(numbers), bool)


def test_run_streams_of_large_inputs_are_as_small():
    batch, least = lettered(20_000, 300, 1), 100
    pairs = 50 * (20_000 // 50 - 1)
    for size in (10**6, 10**9, 10**10, 10**13):
        parts = min(collocations.parts_for(size, collocations.PART_BYTES), 5_000)
        bits = collocations.run_bits(size, parts)
        out = list(collocations._run_streams([every], bits, parts, least)(iter([batch])))
        assert sum(len(b.as_py()) for o in out for name in ("ids", "counts") for b in o.column(name)) <= 5 * pairs


def test_runs_of_many_chunks_are_summed():
    least, bits, parts, kept = 5, collocations.run_bits(10**12, 3), 3, 20
    rng = np.random.default_rng(2)
    streams, total = [[] for _ in range(parts)], Counter()
    edges = [(i << bits) // parts for i in range(parts + 1)]
    for _ in range(40):
        numbers, counts = np.unique(np.concatenate([rng.integers(0, 1 << bits, 200), rng.choice([7, 1 << 32, (1 << bits) - 1, *edges[1:3]], 9)]), return_counts=True)
        total.update(dict(zip(numbers.tolist(), counts.tolist())))
        for i in range(parts):
            own = (numbers >= edges[i]) & (numbers < edges[i + 1])
            streams[i].append(((numbers[own] - edges[i]).astype(np.uint32).tobytes(), np.minimum(counts[own], least).astype(np.uint8).tobytes()))
    found = set()
    for i in range(parts):
        table = pa.table({"ids": pa.array([s[0] for s in streams[i]], pa.binary()), "counts": pa.array([s[1] for s in streams[i]], pa.binary())})
        out = collocations._merged(bits, parts, least, kept)((pa.scalar(i),), table).to_pylist()[0]
        found |= set((np.flatnonzero(np.unpackbits(np.frombuffer(out["marks"], np.uint8), bitorder="little")) + 8 * out["at"]).tolist())
    assert found == {x >> (bits - kept) for x, n in total.items() if n >= least} and len(found) == 5
    pairs = np.sort(np.repeat(np.arange(1, 50, dtype=np.uint64), 3) << np.uint64(32) | np.uint64(2))
    for block in (1, 2, 7, 1000):
        assert collocations._often(pairs, 6, block).tolist() == [*range(1, 50)] and collocations._often(pairs, 7, block).tolist() == []


def test_phrases_are_merged_in_little_memory():
    """A part holds many phrases that come once in a chunk; few of them are frequent."""
    least, streams, plain = 30, collocations._phrase_streams([every] * 3, 5, 1), Counter()
    batches = [lettered(10_000, 40, seed) for seed in range(12)]
    table = pa.Table.from_batches([o for b in batches for o in streams(iter([b]))])
    for text in (t for b in batches for t in b.column("text").to_pylist()):
        words = text.split(" ")
        for k in range(2, 6):
            plain.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    want = sorted(n for n in plain.values() if n >= least)
    found = []
    for k in range(2, 6):
        own = table.filter(pa.compute.equal(table["words"], k))
        for most in (1 << 18, 1000):
            merge = collocations._merged_phrases(least, most)
            tracemalloc.start()
            out = merge((pa.scalar(0), pa.scalar(k)), own)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert {len(x) for x in out["key"].to_pylist()} <= {8 * (k + 1)}
            assert len(set(out["key"].to_pylist())) == out.num_rows
        found += out["n"].to_pylist()
        if k == 5:
            rows = sum(own["rows"].to_pylist())
            assert rows > 100_000 and peak < 60 * rows
    assert sorted(found) == want and len(want) > 1000


def test_sets_are_sent_compressed():
    marks = np.zeros(1 << 20, np.uint8)
    marks[[3, 77_777]] = 5
    for known in (collocations.TopBits(23, marks), collocations.LastBits(marks.view(np.uint64))):
        sent = cloudpickle.dumps(known.has)
        numbers = np.random.default_rng(3).integers(0, 1 << 63, 200_000).astype(np.uint64)
        assert len(sent) < 50_000 and (pickle.loads(sent)(numbers) == known.has(numbers)).all()


def test_scores_beyond_64_bits(spark):
    rows = [(i, "rare pair. " + "common " * 3_000, "en") for i in range(150)]
    top = collocations.collocations(table(spark, rows)).where("phrase = 'rare pair'").first()
    n = 150 * 3_002
    assert (top["a"], top["n"], top["score"]) == (150, n, 1000 * n // 150)
    wide = spark.range(1).selectExpr("(1000 * CAST(900000000000 AS DECIMAL(19, 0)) * CAST(16000000000000 AS DECIMAL(15, 0))) DIV (CAST(910000000000 AS DECIMAL(19, 0)) * CAST(920000000000 AS DECIMAL(19, 0))) AS s")
    assert wide.first()["s"] == 1000 * 900000000000 * 16000000000000 // (910000000000 * 920000000000)


def test_streams_of_differences():
    rng = np.random.default_rng(1)
    for scale in (1, 100, 10**6):
        ids = 500 + np.sort(rng.integers(0, 1000 * scale, 700))
        data = ngram_join.packed_differences(ids, 500)
        assert (ngram_join.unpacked_differences(data, 500) == ids).all()
    assert len(ngram_join.unpacked_differences(ngram_join.packed_differences(np.zeros(0, np.int64), 0), 0)) == 0


@pytest.mark.parametrize("limits", [{}, {"digit_bits": 3, "tile": 5}])
def test_importance(spark, limits):
    rows = common_rows() + [(100 + i, prose(i, 5 + i % 40, 90), "en") for i in range(300)] + [(500 + i % 3, prose(1, 30, 90), "en") for i in range(40)]
    target = [prose(900, 200, 30), None, "", prose(901, 50, 30)]
    goal = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    want = Counter(importance.brute_force([(i, t) for i, t, _ in rows], target))
    found = importance.resample(table(spark, rows), goal, **limits)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == want and sum(r[4] is not None for r in want.elements()) >= 8


def test_importance_of_nothing(spark):
    rows, goal = common_rows(), spark.createDataFrame([("1", "a b")], "item_id string, text string")
    docs = table(spark, rows)
    assert importance.resample(docs.where("false"), goal).collect() == []
    found = importance.resample(docs, goal.where("false"))
    assert Counter(map(tuple, found.collect())) == Counter(importance.brute_force([(i, t) for i, t, _ in rows], []))
    few = importance.resample(docs.where("doc_id IN (1, 8)"), goal).collect()
    assert len(few) == 3 and {r["rank"] for r in few} == {None}


def test_radix_sort(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), rng.randrange(1 << 20), i) for i in range(900)]
    df = spark.createDataFrame(rows, "a long, b long, i long").repartition(7)
    got = {r["i"]: r["place"] for r in radix.radix_sorted(df, [2, 20], ["a", "b"], "place", digit_bits=5, tile=50).collect()}
    assert sorted(got.values()) == list(range(900))
    order = sorted(rows, key=lambda r: got[r[2]])
    assert [r[:2] for r in order] == sorted(r[:2] for r in rows)
    assert radix.digits_of([0, 20], 8) == [(1, 0, 6), (1, 6, 7), (1, 13, 7)]
    assert radix.radix_sorted(df.where("false"), [2, 20], ["a", "b"], "place").collect() == []


def family(rng, base, n):
    """Copies of a text with some words changed or added."""
    for _ in range(n):
        words = list(base[: rng.choice([20, 40, 60, 120])])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(2_000)}"
        yield rng.choice([" ", "\n", "  "]).join(words + [f"v{rng.randrange(99)}" for _ in range(rng.choice([0, 0, 9]))])


@pytest.mark.parametrize("limits", [{"rare": 4, "common": 16, "few": 4, "block": 32, "part_bytes": 9_000}, {"rare": 4, "common": 16, "most": 300}])
def test_ngram_join(spark, limits):
    rng = random.Random(4)
    texts = list(family(rng, [f"b{rng.randrange(300)}" for _ in range(120)], 350))
    passage = prose(3, 40)
    texts += [f"{passage} {prose(1_000 + i, rng.randrange(1, 30))}" for i in range(150)]
    rows = common_rows() + [(100 + i, t, "en") for i, t in enumerate(texts)]
    rows += [(20, "a b c d e f g", "en"), (21, "a b c d e f g h", "en"), (21, "A b c d e f g h i j", "en"), (None, "z", "en")]
    found = ngram_join.ngram_join(table(spark, rows), **limits)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    want = Counter(ngram_join.brute_force([(i, t) for i, t, _ in rows]))
    assert Counter(map(tuple, found.collect())) == want and 3 < len({r[2] for r in want}) < len(rows) - 100


def test_ngram_join_at_the_threshold(spark):
    """17 of 20 shingles are in common: linked; one more that differs: not."""
    first = [f"s{i}" for i in range(23)]  # 20 shingles
    longer = [*first, "t0", "t1", "t2"]  # 23, of which 20 are in common: 0.8696
    longest = [*first, "u0", "u1", "u2", "u3"]  # 24: 0.8333
    rows = [(1, " ".join(first), "en"), (2, " ".join(longer), "en"), (3, " ".join(longest), "en")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert ngram_join.ngram_join(table(spark, rows).where("false")).collect() == []


def test_prefix_keys_find_every_similar_pair():
    """Whatever the order and the classes of tokens: sets that reach the threshold share a key."""
    rng = random.Random(9)
    for _ in range(1_500):
        n, common = rng.choice([6, 9, 20, 60, 150]), rng.random()
        x = rng.sample(range(1 << 40), n)
        y = list(x)
        for _ in range(rng.randrange(n)):
            if rng.random() < 0.5:
                y[rng.randrange(len(y))] = rng.randrange(1 << 40)
            elif rng.random() < 0.5:
                y.append(rng.randrange(1 << 40))
        x, y = set(x), set(y)
        if 100 * len(x & y) < 85 * len(x | y):
            continue
        cls = {t: 0 if t not in x or t not in y else 1 if (t * 7919) % 1000 >= 1000 * common else 2 + t % 2 for t in x | y}
        keys = []
        for s in (x, y):
            own = sorted(s, key=lambda t: (cls[t], t))
            keys.append(set(ngram_join.prefix_keys(np.array(own, np.uint64), np.array([cls[t] for t in own], np.int8), (85, 100)).tolist()))
        assert x == y or keys[0] & keys[1]


def test_parity_bits_never_rule_out_similar_sets():
    rng = np.random.default_rng(2)
    for n in (1, 7, 30, 200, 900):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 9], rng.integers(0, 1 << 62, n // 5).astype(np.uint64)])
        x, y = (np.frombuffer(linking.parity(s), np.uint64).reshape(1, -1) for s in (a, b))
        words = min(x.shape[1], y.shape[1])
        differ = int(np.bitwise_count(linking._folded(x, words) ^ linking._folded(y, words)).sum())
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_bitmaps(spark):
    numbers = [(-5,), (0,), (63,), (1 << 62,), (-(1 << 63),), (None,)]
    made = bitmaps.bitmap_of(spark.createDataFrame(numbers, "v long").where("v IS NOT NULL"), "v", bits=1 << 12)
    own = np.array([n for (n,) in numbers if n is not None], np.int64).view(np.uint64)
    assert bitmaps.in_bitmap(made, own).all() and not bitmaps.in_bitmap(made, np.array([7], np.uint64)).any()
    held = spark.createDataFrame([(-5,), (7,)], "v long").where(bitmaps.may_hold(made)(F.col("v"))).collect()
    assert [r["v"] for r in held] == [-5]


def test_components_of_a_hub(spark):
    hub = spark.range(1, 3_000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    chain = spark.range(5_000, 5_040).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    roots = {r["node"]: r["root"] for r in components.components(hub.union(chain)).collect()}
    assert len(roots) == 2_999 + 40 and set(roots.values()) == {0, 5_000}


def test_repeated_numbers_block_by_block():
    rng = random.Random(4)
    streams = [sorted(rng.randrange(100, 400) for _ in range(300)) + [900_000] * 2 for _ in range(3)]
    ids = ngram_join.merged_differences([ngram_join.packed_differences(np.array(s, np.int64), 100) for s in streams], 100)
    assert ids.tolist() == sorted(sum(streams, []))
    for least in (1, 2, 4):
        want = {k: n for k, n in Counter(ids.tolist()).items() if n >= least}
        for block in (1, 7, 1 << 20):
            numbers, counts = ngram_join.repeated(ids, least, block)
            assert dict(zip(numbers.tolist(), counts.tolist(), strict=True)) == want and len(numbers) == len(want)
    assert [len(a) for a in ngram_join.repeated(ids[:0], 2)] == [0, 0]


def test_members_of_common_keys_meet_their_roots_once(spark, monkeypatch):
    """One row for each node goes through the join, however many keys it has in common with others."""
    sets = {node: np.array([*range(64), 1_000 + node], np.uint64) for node in range(11)} | {11: np.arange(5_000, 5_064, dtype=np.uint64)}
    keyed = spark.createDataFrame([(key, node, len(s)) for key in range(30) for node, s in sets.items()], "key long, node long, weight long")
    rows = [(node, len(s), bytearray(linking.parity(s)), s.tolist()) for node, s in sets.items()]
    details = spark.createDataFrame(rows, f"node long, {linking.DETAILS}")
    real, seen = linking._between, []
    monkeypatch.setattr(linking, "_between", lambda held, *a: seen.append(held.count()) or real(held, *a))
    assert {tuple(r) for r in linking.linked(keyed, details, (85, 100)).collect()} == {(node, 0) for node in range(1, 11)}
    assert set(seen) == {len(sets)}


def test_keys_of_frequent_tokens_are_few():
    """Combinations grow with the size of a set, by less than 1.5 keys for each of its tokens in pairs and 4 in threes."""
    for n in (100, 300, 1_000, 3_000):
        tokens = linking.mixed(np.arange(n))
        for kind, most in ((2, 1.5), (3, 4)):
            assert 0 < len(ngram_join.prefix_keys(tokens, np.full(n, kind, np.int8), (85, 100))) < most * n


def test_members_are_joined_with_their_keys_once(spark, monkeypatch):
    every = spark.createDataFrame([(1, 5, 9), (1, 3, 9), (2, 5, 9)], "key long, node long, weight long")
    sized = linking.with_sizes(every)
    names = ["key", "node", "weight", "n", "low", "high"]
    assert sorted(map(tuple, sized.select(*names).collect())) == [(1, 3, 9, 2, 3, 5), (1, 5, 9, 2, 3, 5)]
    real, seen = linking.with_sizes, []
    for module in (linking, ngram_join, near):
        monkeypatch.setattr(module, "with_sizes", lambda df: seen.append(df) or real(df))
    passage = prose(3, 40)
    docs = table(spark, [(i, f"{passage} {prose(500 + i, 2)}", "en") for i in range(12)])
    assert {r["component_id"] for r in ngram_join.ngram_join(docs).collect()} == {0} and len(seen) == 1
    assert {r["class_id"] for r in near.near_duplicates(docs).collect()} == {0} and len(seen) == 2
