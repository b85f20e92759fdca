"""Every operator on small hand-made tables: nulls, empty and long texts, repeats, clashing columns, empty tables."""

import hashlib
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assaylane.llm import bpe, common, counting, decontaminate, near, packing, ppm, pretokens, quality, repeats, secrets, topk
from assaylane.llm.queries import BYTE_BPE, WORD_BPE

SCHEMA = "doc_id long, text string, lang string, source string, block string, key string, ids string, n long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(["an", "the", "on", "er", "st", "ou", "re"], k=rng.randint(1, 4))) for _ in range(n))


def passages():
    base = prose(1, 160)
    words = base.split()
    words[80] = "changed"
    long = prose(3, 30_000)
    return [
        (1, base, "en"), (2, base, "en"), (3, " ".join(words), "en"), (4, None, "en"), (5, "", None), (6, "  \n ", "en"),
        (7, long, "en"), (8, "x" * 3_000, "de"), (9, prose(4, 50) + " " + base[100:700] + " " + prose(5, 50), "de"),
        (9, prose(4, 50) + " " + base[100:700] + " " + prose(5, 50), "de"), (None, "ünïcode ça va, it's 12'000 日本 😀", "fr"),
        (10, 'key token = "8ebf1c0d2a9377e4bb01" end', "en"), (11, "a b", "en"),
    ]


@pytest.fixture(scope="module")
def rows():
    return passages()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "b", "k", "i", 1) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_pretokens_follow_the_pattern():
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(5)
    alphabet = list("aétx12 .,'\n\t  ''srvelmd!?") + [" ", "　", "\x1c", "日", "😀"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(25))) for _ in range(2_000)]
    split = pretokens.split(texts)
    for i, text in enumerate(texts):
        assert [split.word(j) for j in range(split.first[i], split.first[i + 1])] == pattern.findall(text)


def test_bpe(docs, none, rows):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, BYTE_BPE).collect())
    assert got == Counter((i, *bpe.digest_of(t, BYTE_BPE)) for i, t, _ in rows)
    assert bpe.digests(none, BYTE_BPE).collect() == []
    plain, fused = bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE), bpe.encode(docs, BYTE_BPE, with_decoded=True)
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, fused.collect()))


def test_token_counts(docs, none, rows):
    tokenizer = counting._tokenizer(WORD_BPE)
    want = Counter(
        (i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows
    )
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in counting.count_tokens(docs, WORD_BPE, 10).collect()) == want
    assert counting.count_tokens(none, WORD_BPE, 10).collect() == []


def test_token_counts_of_special_strings(spark):
    texts = ["<|ENDOFTEXT|>", "<|endoftext|>", "a <|StartOfText|> B", "x<|startoftext|>y, <|EndOfText|>.", "<|endoftext|>END, <|OTHER|>"]
    tokenizer = counting._tokenizer(WORD_BPE)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in counting.count_tokens(table, WORD_BPE, 10).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_packing_is_lossless(docs, none, rows):
    packed = packing.pack_tokens(docs.where("doc_id <> 9 AND doc_id IS NOT NULL"), BYTE_BPE, 50_256, length=64).collect()
    pieces = {}
    for row in packed:
        ids, at = np.frombuffer(row.ids, "<u2"), row.cu_seqlens
        assert len(ids) == 64 and at[-1] <= 64
        for n, (doc, piece) in enumerate(zip(row.doc_ids, row.pieces, strict=True)):
            pieces[doc, piece] = ids[at[n] : at[n + 1]].tolist()
            assert np.frombuffer(row.position_ids, "<u2")[at[n]] == 0
    encoder = bpe._encoder(BYTE_BPE)
    for i, text, _ in rows:
        if i not in (9, None):
            own = [x for n in range(sum(d == i for d, _ in pieces)) for x in pieces[i, n]]
            assert own == encoder.encode_ordinary(text or "")
    assert packing.pack_tokens(none, BYTE_BPE, 50_256).collect() == []


def encoded_alone(texts):
    encoder = bpe._encoder(BYTE_BPE)
    return [encoder.encode_ordinary(t) for t in texts]


def encoded_together(texts):
    ids, first = packing._encode_batch(BYTE_BPE, texts)
    return [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]


def test_packing_takes_known_words_all_at_once(monkeypatch):
    monkeypatch.delitem(sys.modules, common._CACHE, raising=False)
    texts = ["", " ".join(f"{i:x}lé{i * i:x}" for i in range(3_000)), "a  b\n", prose(5, 300)]
    assert encoded_together(texts) == encoded_alone(texts)
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event.endswith("call") else None)
    try:
        ids, _ = packing._encode_batch(BYTE_BPE, texts)
    finally:
        sys.setprofile(None)
    assert len(calls) < 500 and ids.tolist() == sum(encoded_alone(texts), [])


def test_packing_where_words_have_one_hash(monkeypatch):
    monkeypatch.delitem(sys.modules, common._CACHE, raising=False)
    own = pretokens.Split.hashes
    monkeypatch.setattr(pretokens.Split, "hashes", lambda self: own(self) & np.uint64(7))
    for n in range(3):
        texts = [prose(n, 200), "", "ab ba"]
        assert encoded_together(texts) == encoded_alone(texts)


def test_packing_forgets_words_at_the_limit(monkeypatch):
    monkeypatch.delitem(sys.modules, common._CACHE, raising=False)
    monkeypatch.setattr(packing, "KNOWN_WORDS", 500)
    kept = []
    for n in range(6):
        texts = [" ".join(f"{n}x{i}yü" for i in range(400)), "\U0001f600 a'll" * n, prose(n, 50)]
        assert encoded_together(texts) == encoded_alone(texts)
        kept.append(common.worker_cache(("ids of words", BYTE_BPE), None, large="bpe").n)
    assert max(kept) < 1_100 and any(b < a for a, b in zip(kept, kept[1:], strict=False))


def test_known_words_with_full_and_shared_slots():
    known, rng = packing.KnownWords(), np.random.default_rng(1)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 40_000, np.uint64), np.arange(1 << 63, (1 << 63) + 30_000, 3, np.uint64) << np.uint64(17)]))
    for part in np.array_split(rng.permutation(hashes), 7):
        assert (known.find(part) == -1).all()
        one = np.ones(len(part), np.int64)
        known.add(part, part.astype(np.uint32), one, part.astype(np.uint32), one)
    numbers = known.find(hashes)
    assert len(np.unique(numbers)) == len(hashes) == known.n and (known.hashes[numbers] == hashes).all()
    assert known.holds(numbers, hashes.astype(np.uint32), np.ones(len(hashes), np.int64))
    assert not known.holds(numbers[::-1], hashes.astype(np.uint32), np.ones(len(hashes), np.int64))
    assert (known.ids_of(numbers)[0] == hashes.astype(np.uint32)).all()


def test_best_fit_decreasing():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    rooms, want = [], []
    for size in sizes:
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms[rooms.index(min(fits))] -= size
        else:
            rooms.append(100 - size)
        want.append(sum(rooms))
    used = Counter()
    for size, row in zip(sizes, packing.best_fit_decreasing(sizes, 100), strict=True):
        used[row] += size
    assert max(used.values()) <= 100 and len(used) == len(rooms)


def test_decontamination(spark, docs, none, rows):
    base = rows[0][1].split()
    items = [(1, " ".join(base[20:45])), (2, "A, b!"), (3, None), (4, prose(99, 30)), (1, " ".join(base[20:45]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r)[0:6] for r in decontaminate.digests(docs, table).collect())
    assert got == Counter((i, *decontaminate.digest_of(t, items)) for i, t, _ in rows)
    small = decontaminate.find_contamination(docs, table, automaton_bytes=300)  # several automata
    assert {r.doc_id: r.n_hit for r in small.collect()} == {r[0]: r[2] for r in got}
    assert decontaminate.digests(none, table).collect() == []
    assert decontaminate.digests(docs, table.where("false")).where("contaminated").collect() == []
    spans = {r.doc_id: (r.text, r.spans) for r in small.where("n_hit > 0").collect()}
    text, (a, b) = spans[1]
    assert text[a:b] == " ".join(base[20:45])


def test_decontamination_takes_each_text_once_to_one_worker(spark, docs, rows):
    table = spark.createDataFrame([(1, " ".join(rows[0][1].split()[20:45]))], "item_id long, text string")
    found = decontaminate.find_contamination(docs, table, keep=("doc_id", "text"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    plain = decontaminate.find_contamination(docs, table)
    assert found.columns == plain.columns
    assert Counter(map(str, found.collect())) == Counter(map(str, plain.collect()))
    binary = docs.withColumn("raw", F.col("text").cast("binary"))
    kept = decontaminate.find_contamination(binary, table, text="raw", keep=("doc_id", "raw"))
    assert dict(kept.dtypes)["raw"] == "binary" and kept.where("n_hit > 0").count() == plain.where("n_hit > 0").count()


def test_repeats(docs, none, rows):
    want = repeats.brute_force([(t or "").encode() for _, t, _ in rows])
    found = repeats.repeated_passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, found.collect())) == Counter((i, *w) for (i, _, _), w in zip(rows, want, strict=True))
    assert repeats.repeated_passages(none).collect() == []


def test_repeats_across_pieces(spark):
    passage = prose(11, 120_000)
    assert len(passage) > 600_000
    texts = [prose(12, 120_000), "one " + passage + prose(13, 40), prose(14, 70) + passage]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = repeats.repeated_passages(table).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = repeats.brute_force([t.encode() for t in texts])
    assert want[0][1] == 0 and want[1][1] >= len(passage)
    assert {tuple(r) for r in found} == {(i, *w) for i, w in enumerate(want)}
    for t in texts:
        at = repeats.anchors(np.frombuffer(t.encode(), np.uint8))[1]
        assert (np.diff(at) > 0).all()


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(301, None), (302, [float("nan")] * 5), (303, [None] * 5), (None, [1.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    valid = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v in rows[:180]]
    want = set()
    for q, a in valid:
        if q % 20 == 0:
            best = sorted((-int(a @ b), i) for i, b in valid if i != q)[:20]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(table, 20, 20).collect()} == want
    few = {tuple(r) for r in topk.top_k(table.where("vec_id < 3"), 20, 20).collect()}
    assert {(q, n) for q, n, _, _ in few} == {(0, 1), (0, 2)}
    assert topk.top_k(table.where("false"), 20, 20).collect() == []


def similar(rows):
    sets = {}
    for i, t, _ in rows:
        words = near.words_of(t or "")
        sets[i] = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else None
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and x and y and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_near_duplicates(docs, none, rows):
    named = [r for r in rows if r[0] is not None]
    got = {r.doc_id: r.class_id for r in near.near_duplicates(docs).collect()}
    assert {k: v for k, v in got.items() if k is not None} == similar(named)
    assert near.near_duplicates(none).collect() == []


def test_near_duplicates_of_versions(spark):
    first, second, third, other = prose(21, 200), prose(22, 200), prose(23, 200), prose(24, 200)
    near_copy = lambda text, word: " ".join([*text.split()[:-1], word])
    rows = [
        (1, first), (1, second), (2, near_copy(first, "end")), (3, near_copy(second, "end")), (4, other), (None, None), (5, ""),
        (6, third), (10, third), (10, near_copy(other, "end")), (12, prose(25, 200)), (13, None), (13, prose(25, 200).upper()),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in near.near_duplicates(table).collect() if r.doc_id is not None}
    assert got == {i: (1, 4) for i in (1, 2, 3)} | {i: (4, 4) for i in (4, 6, 10)} | {5: (5, 1)} | {i: (12, 3) for i in (12, 13)}


def test_signatures_estimate_similarity():
    a, b = prose(1, 400), prose(1, 400)[:-200] + prose(8, 60)
    cells, of = near.units(*near.shingles([a, b]))
    table = near.signatures(cells, of, 2, 2_000)
    x, y = set(cells[of == 0]), set(cells[of == 1])
    assert abs((table[0] == table[1]).mean() - len(x & y) / len(x | y)) < 0.05


def test_language(spark, docs, none):
    texts = [("xx", prose(i, 60)) for i in range(40)] + [("yy", prose(i, 60).replace("t", "zq").replace("o", "ui")) for i in range(40)]
    train = spark.createDataFrame(texts, "lang string, text string")
    told = {r.doc_id: r for r in ppm.predict(docs, ppm.fit(train)).collect()}
    assert {told[i].lang_pred for i in (4, 5, 6)} == {"und"} and told[1].lang_pred == "xx" and told[7].score > 0.9
    assert {r.lang_pred for r in ppm.predict(docs, ppm.fit(train.where("false"))).collect()} == {"und"}
    assert ppm.predict_documents(none).collect() == []


def test_code_lengths_sum_to_a_distribution():
    grams, _ = ppm.grams_of([b"abracadabra", b"banana bandana"])
    tree = ppm.Tree(*np.unique(grams, return_counts=True))
    for before in (b"abr", b"ana", b"zzz"):
        head = int.from_bytes(before, "big") << 8
        total = sum(2 ** -tree.bits(head | c) for c in range(256))
        assert total == pytest.approx(1, abs=1e-9)


def test_held_out_language_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    told = ppm.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert told.where("lang = lang_pred").count() >= 0.97 * told.count()


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 7, None)] + [(8, 0, 0)], "doc_id long, quality int, toxic int")
    told = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert told[4].perplexity is None and not told[4].keep and told[5].perplexity is None
    assert told[8].perplexity > told[7].perplexity
    assert all(r.keep for r in quality.classify(docs, labels.where("false")).where("perplexity IS NOT NULL").collect())
    assert quality.classify(none, labels).collect() == []


def test_kneser_ney_sums_to_one(spark):
    grams, n = np.unique(ppm.grams_of([prose(1, 300).encode()])[0], return_counts=True)
    counts = spark.createDataFrame([("x", int(g), int(c)) for g, c in zip(grams, n, strict=True)], "lang string, gram long, n long")
    head = int(grams[len(grams) // 2]) >> 8 << 8
    asked = spark.range(256).select(F.lit("x").alias("lang"), (F.col("id") + head).alias("gram"))
    total = quality.code_lengths(counts, asked).agg(F.sum(F.pow(F.lit(2.0), -F.col("bits")))).first()[0]
    assert total == pytest.approx(1, abs=1e-9)


def test_secrets(spark, docs, none):
    value = "8ebf1c0d2a9377e4bb01"
    text = 'key token = "8ebf1c0d2a9377e4bb01" end'
    found = secrets.find_secrets(docs).collect()
    assert (10, text.index(value), 20, hashlib.sha256(value.encode()).hexdigest()) in {tuple(r)[:4] for r in found}
    assert secrets.find_secrets(none).collect() == []
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert clean[10].text == 'key token = "[SECRET]" end' and clean[10].block == "b" and clean[4].text is None


def test_forest_removes_false_positives(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    found = secrets.find_secrets(docs).collect()
    assert found and all(any(c.isdigit() for c in rows[r.doc_id][r.start : r.start + r.length]) for r in found)


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, data)
        if name != "encoded":
            assert after.columns == docs.columns
        assert 0 < after.count() <= before.count()
        before = spark.createDataFrame(after.collect(), after.schema)
    text = {r.doc_id: r.text for r in docs.collect()}
    root = similar([(k, t, None) for k, t in text.items()])
    kept = {r.doc_id for r in before.collect()}
    assert len({root[k] for k in kept}) == len(kept)


def test_stages_keep_columns_of_any_name(spark, data):
    import corpus_pipeline

    plain = spark.read.parquet(f"{data}/documents.parquet")
    clashing = plain.selectExpr("*", "0L AS n_hit", "'x' AS items", "0.0 AS score", "'und' AS lang_pred", "1L AS n_words")
    for stage in (corpus_pipeline.language, corpus_pipeline.near_duplicates, corpus_pipeline.decontaminated, corpus_pipeline.redacted):
        got = stage(spark, clashing, data)
        assert got.columns == clashing.columns
        want = Counter(map(tuple, stage(spark, plain, data).select("doc_id", "text").collect()))
        assert Counter((r.doc_id, r.text) for r in got.collect()) == want
        assert {(r.n_hit, r.items, r.score, r.lang_pred, r.n_words) for r in got.collect()} == {(0, "x", 0, "und", 1)}


def test_language_takes_texts_in_pieces(spark, monkeypatch):
    """A batch never becomes Python objects as a whole, and the results are those of one piece."""
    rows = [(i, f"{'the cat sat on' if i % 2 else 'der hund lief um'} {'x' * (i % 7)}", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows + [(60, None, None), (61, "the cat " * 40, None)], "doc_id long, text string, lang string")
    model = ppm.fit(docs)
    whole = sorted(map(tuple, ppm.predict(docs.coalesce(1), model).collect()))
    real = ppm.Scorer.lengths

    def lengths(self, texts):
        if len(texts) > 1 and sum(map(len, texts)) > 100:
            raise ValueError("more than a piece")
        return real(self, texts)

    monkeypatch.setattr(ppm, "_CHUNK", 100)
    monkeypatch.setattr(ppm.Scorer, "lengths", lengths)
    assert sorted(map(tuple, ppm.predict(docs.coalesce(1), model).collect())) == whole and len(whole) == 62


def test_large_values_of_another_operator_go():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    first, second = bpe.encoder(path), bpe.token_bytes(path)
    assert bpe.encoder(path) is first and bpe.token_bytes(path) is second  # they are used together
    common.worker_cache(("ppm", "a model"), list, large="ppm")
    assert bpe.encoder(path) is not first and bpe.token_bytes(path) is not second
