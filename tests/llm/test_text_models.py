"""Line field, recurrent network, byte-level BPE and records."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from remitlens.llm import byte_bpe, gru_lm, quality_crf, records

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "Hello  world, it's 2024!\r\n", "ünï cödé ß", "日本語 テキスト 🙂🙂", "a" * 5000, " " * 300, "\x1c\x85 x", "<|endoftext|> x"]


def docs_of(spark, texts, **more):
    rows = [(i, t, *more.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in more))


# Line field


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lines_of = np.array([3, 1, 4])
    scores, step = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    found, pairs, log_sum = quality_crf.marginals(scores, lines_of, step)
    at, pair_total = 0, np.zeros((2, 2))
    for k, n in enumerate(lines_of):
        weight = {y: math.exp(sum(scores[at + t, y[t]] for t in range(n)) + sum(step[y[t], y[t + 1]] for t in range(n - 1))) for y in product((0, 1), repeat=n)}
        total = sum(weight.values())
        assert log_sum[k] == pytest.approx(math.log(total))
        for t in range(n):
            assert found[at + t, 1] == pytest.approx(sum(w for y, w in weight.items() if y[t]) / total)
        for y, w in weight.items():
            for t in range(n - 1):
                pair_total[y[t], y[t + 1]] += w / total
        at += n
    assert pairs == pytest.approx(pair_total)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_crf.fit(docs.where(~quality_crf.held_out()), labels)
    scored = quality_crf.score(docs, model).where(quality_crf.held_out()).join(labels, "doc_id").collect()
    right = sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in scored)
    assert right >= 0.95 * len(scored) and len(scored) > 10


def test_a_spliced_document_has_lines_of_both_kinds(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_crf.fit(docs.where(~quality_crf.held_out()), labels)
    rows = docs.where(quality_crf.held_out()).join(labels, "doc_id").orderBy("doc_id").select("text", "quality").collect()
    good, bad = ([r["text"] for r in rows if r["quality"] == k and r["text"].count("\n") > 1][:12] for k in (1, 0))
    assert len(bad) > 5
    right = []
    for g, b in zip(good, bad, strict=False):
        for parts, kinds in (((g, b), (1, 0)), ((b, g), (0, 1))):
            features, _, lines_of = quality_crf.line_features(["\n".join(parts)])
            called = quality_crf.line_marginals(model, features, lines_of) > 0.5
            truth = np.concatenate([np.full(t.count("\n") + 1, k) for t, k in zip(parts, kinds, strict=True)])
            assert called.any() and not called.all()
            right += (called == truth).tolist()
    assert np.mean(right) > 0.85


def test_long_labelled_documents_and_unlabelled_ids_leave_the_sample_whole(spark, monkeypatch):
    monkeypatch.setattr(quality_crf, "SAMPLE_DOCS", 6)
    rows = [(i, "\n".join(f"plain words of line {j}, as they come." for j in range(3000 if i == 0 else 2))) for i in range(3)]
    rows += [(i, "\n".join("### BUY $$$ NOW !!! |||" for _ in range(3000 if i == 3 else 2))) for i in range(3, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(6)] + [(i, 1) for i in range(100, 400)], "doc_id long, quality int")
    learnt, own = [], quality_crf.fit_field
    monkeypatch.setattr(quality_crf, "fit_field", lambda x, n, y: learnt.append((len(x), y.mean())) or own(x, n, y))
    found = {r["doc_id"]: r["score"] for r in quality_crf.score(docs, quality_crf.fit(docs, labels)).collect()}
    assert learnt[0][0] >= 2 * quality_crf.SAMPLE_LINES and 0.4 < learnt[0][1] < 0.6
    assert all((found[i] > 0.5) == (i < 3) for i in range(6))


def test_quality_of_odd_texts_and_clashing_columns(spark):
    docs = docs_of(spark, [*ODD, "good line", "good line"], SCORE="x", lang=None)
    labels = spark.createDataFrame([(11, 1), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality_crf.fit(docs, labels)
    found = {r["doc_id"]: r["score"] for r in quality_crf.score(docs, model).collect()}
    assert len(found) == len(ODD) + 2 and all(0 <= s <= 1 for s in found.values())
    assert found[11] == found[12] and found[0] == found[1]


def test_quality_without_labels_or_documents(spark):
    docs = docs_of(spark, ["a", "b"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_crf.score(docs, quality_crf.fit(docs, none)).collect()} == {0.5}
    assert quality_crf.score(docs.limit(0), quality_crf.fit(docs.limit(0), none)).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality_crf.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    learnt = docs.where(~quality_crf.held_out())
    a, b = quality_crf.fit(learnt, labels), quality_crf.fit(learnt, flipped)
    assert np.array_equal(a["weights"], b["weights"]) and a["curve"] == b["curve"]


# Recurrent network


def vocabulary_of(texts):
    counts = Counter(w for t in texts for w in gru_lm.split(t))
    common = sorted(((w.decode(), c) for w, c in counts.items()), key=lambda x: (-x[1], x[0]))
    common.append((gru_lm.END, len(texts)))
    mass = [0.0] * gru_lm.TAIL_CLASSES
    v = gru_lm.Vocabulary(common, sum(c for _, c in common), len(common), mass)
    for w, c in common:
        if w and v.index[w.encode()] >= v.head:
            mass[gru_lm.tail_class(w.encode())] += c + 0.5
    v.tail_mass = np.array(mass) + 0.5
    return v


def test_gradients(monkeypatch):
    monkeypatch.setattr(gru_lm, "HEAD", (6, 6))
    monkeypatch.setattr(gru_lm, "HEAD_CLASS", 4)
    texts = ["a b c d e f g a b", "b a q q", "z"]
    v = vocabulary_of(texts)
    docs = [v.symbols(gru_lm.split(t))[1] for t in texts]
    rng = np.random.default_rng(1)
    p = {k: (x + rng.normal(size=x.shape) * 0.1 * (x > -20)).astype(float) for k, x in gru_lm.initial(v).items()}

    def loss(p, grads=None):
        ((inputs, targets, fresh, place),) = gru_lm.windows(docs, v.start, (2, 100))
        states, kept = gru_lm.forward(p, inputs, fresh, np.zeros((inputs.shape[1], gru_lm.HIDDEN)))
        real, back = place.ravel() >= 0, np.zeros((place.size, gru_lm.HIDDEN))
        log_p, part = gru_lm.output(p, v, states.astype(float).reshape(-1, gru_lm.HIDDEN)[real], targets.ravel()[real], grads)
        if grads is not None:
            back[real] = part
            gru_lm.backward(p, inputs, fresh, kept, back.reshape(states.shape), grads)
        return -log_p.sum()

    grads = {k: np.zeros_like(x) for k, x in p.items()}
    loss(p, grads)
    for k, x in p.items():
        for i in rng.choice(x.size, 4, replace=False):
            at, eps = np.unravel_index(i, x.shape), 1e-3
            was = x[at]
            x[at] = was + eps
            up = loss(p)
            x[at] = was - eps
            down = loss(p)
            x[at] = was
            assert grads[k][at] == pytest.approx((up - down) / (2 * eps), abs=2e-2, rel=2e-2)


def test_next_symbol_probabilities_sum_to_one(monkeypatch):
    monkeypatch.setattr(gru_lm, "HEAD", (6, 6))
    monkeypatch.setattr(gru_lm, "HEAD_CLASS", 4)
    v = vocabulary_of(["a b c d e f g h i", "a b a"])
    p = gru_lm.initial(v)
    state = np.random.default_rng(0).normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    symbols = np.arange(v.head + gru_lm.TAIL_CLASSES)
    log_p, _ = gru_lm.output(p, v, np.repeat(state, len(symbols), 0), symbols)
    assert np.exp(log_p).sum() == pytest.approx(1, abs=1e-5)


def test_symbols_of_texts_equal_those_of_words():
    import pyarrow as pa

    texts = [*ODD, "a\x0bB\x0cc\td\re\x1cf\x85g\u00a0h ", " lead", "É é É", "\x00 \x1f x", "q" * 300, "", None, *random_texts(9)]
    v = vocabulary_of([t for t in texts[::2] if t])
    column = pa.array(["cut off", *texts], pa.string()).slice(1)
    for t, (found, symbol, rare) in zip(texts, v.of_texts(column), strict=True):
        a, b, c = v.symbols(gru_lm.split(t))
        assert found.tolist() == a.tolist() and symbol.tolist() == b.tolist() and [w.encode() for w in rare] == c
    assert list(v.of_texts(pa.array([], pa.string()))) == []


def test_a_document_scores_alike_alone_and_among_others():
    texts = ["a b c " * n for n in (1, 70, 3, 200, 0)]
    v = vocabulary_of(texts)
    docs = [v.symbols(gru_lm.split(t))[1] for t in texts]
    p = gru_lm.initial(v)
    together = gru_lm.log_likelihoods(p, v, docs)
    for d, x in zip(docs, together, strict=True):
        assert gru_lm.log_likelihoods(p, v, [d])[0] == pytest.approx(x, rel=1e-5)


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "COMMON", 40)  # most words go through the join
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs_of(spark, [None, "", "A a\tA\x0b b", "A a\tA\x0b b"]).select(F.col("doc_id") + 100000, "text"))
    found = {r["doc_id"]: r for r in gru_lm.score_corpus(docs).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter()
    for i, words in texts.items():
        if not held[i]:
            counts.update([*words, None])
    n, v = sum(counts.values()), len(counts)
    for i, words in texts.items():
        r, tokens = found[i], [*words, None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
    out = [r for i, r in found.items() if held[i]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def naive_score(p, v, text, counts):
    """Log10 probability of the text by the network's equations, one word at a time."""
    p = {k: x.astype(float) for k, x in p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, last, total = np.zeros(gru_lm.HIDDEN), v.start, 0.0
    for word in [*text.encode().lower().split(), None]:
        z, r = (sigmoid(p["into"][k][last] + h @ p["state"][k]) for k in (0, 1))
        new = np.tanh(p["into"][2][last] + r * (h @ p["state"][2]))
        h = z * (h - new) + new
        at = 0 if word is None else v.index.get(word, 10**9)
        logits = h @ p["class"] + p["class_bias"]
        of_class = logits - np.log(np.exp(logits).sum())
        if at < v.head:
            group = at // gru_lm.HEAD_CLASS
            inside = h @ p["word"][group] + p["word_bias"][group]
            total += of_class[group] + inside[at % gru_lm.HEAD_CLASS] - np.log(np.exp(inside).sum())
            last = at
        else:
            k = gru_lm.tail_class(word)
            total += of_class[v.groups + k] + math.log((counts[word] + 0.5) / v.tail_mass[k])
            last = v.head + k
    return total / math.log(10)


def test_scores_do_not_depend_on_partitions_and_equal_a_naive_pass(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "SHARD_TOKENS", 2000)
    monkeypatch.setattr(gru_lm, "LEAST_TOKENS", 1)
    monkeypatch.setattr(gru_lm, "FAN", 3)
    monkeypatch.setattr(gru_lm, "COMMON", 3000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    seen, own = {}, gru_lm.train
    monkeypatch.setattr(gru_lm, "train", lambda d, v: seen.setdefault(len(seen), (v, own(d, v)))[1])
    runs = [{r["doc_id"]: r["score"] for r in gru_lm.score_corpus(docs.repartition(n)).collect()} for n in (1, 8)]
    assert all(np.array_equal(seen[0][1][k], seen[1][1][k]) for k in seen[0][1])
    assert runs[0] == pytest.approx(runs[1], rel=1e-5)
    counts, texts = Counter(), {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(t.encode().lower().split())
    v, p = seen[0]
    for i in sorted(texts)[:25]:
        assert runs[0][i] == pytest.approx(naive_score(p, v, texts[i], counts), rel=1e-3)


@pytest.mark.parametrize("n", [1, 7, 50])
def test_every_shard_has_a_partition(spark, n):
    rows = spark.range(20 * n).select((F.col("id") % n).alias("shard"))
    dealt = rows.withColumn("key", F.element_at(gru_lm._partition_keys(spark, n), (F.col("shard") + 1).cast("int"))).repartition(n, "key")
    held = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count_distinct("shard").alias("shards")).collect()
    assert len(held) == n and all(r["shards"] == 1 for r in held)


def test_long_texts_and_words_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "COMMON_BYTES", 4000)
    word = "long" * 100
    docs = docs_of(spark, [f"{word} a {word} b " * 50, "c d " * 25_000, word, None], row="x", score="y")
    found = {r["doc_id"]: r for r in gru_lm.score_corpus(docs).collect()}
    assert [found[i]["n_tokens"] for i in range(4)] == [201, 50_001, 2, 1] and all(math.isfinite(r["score"]) for r in found.values())
    learnt = docs.where("doc_id < 3")
    v = gru_lm.vocabulary(gru_lm.count_words(learnt))
    assert v.index[word.encode()] < v.head  # whatever its length


def test_the_head_grows_with_the_vocabulary():
    assert [gru_lm.head_size(n) for n in (0, 10**5, 10**7, 10**10)] == [1024, 1024, 4096, 4096]


@pytest.mark.parametrize("texts", [[], [None]])
def test_scores_of_next_to_nothing(spark, texts):
    found = gru_lm.score_corpus(docs_of(spark, texts)).collect()
    assert len(found) == len(texts) and all(math.isfinite(r["score"]) and r["n_tokens"] == 1 for r in found)


# Byte-level BPE


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def random_texts(seed=3):
    rng = random.Random(seed)
    low = [chr(c) for c in range(byte_bpe.CACHED_BELOW)]
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    return ["".join(rng.choices(a, k=40)) for a in (low, every, "aabc '\n\t stre1") for _ in range(300)]


def test_ids_are_those_of_rank_merging(tik):
    encoder, decoder = byte_bpe.codec(RANKS, PATTERN)
    texts = [t for t in ODD if t is not None] + random_texts()
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(t)
        assert decoder.decode(ids) == t.encode()


def test_cached_path_equals_the_library(tik):
    encoder = records.library_encoder(JSON, PATTERN)
    texts = [t for t in ODD if t is not None] + random_texts(4) + SPECIAL
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_encode_decode_frames(spark):
    docs = docs_of(spark, ODD, IDS="x", n_tokens="y")
    encoded = byte_bpe.encode(docs, RANKS, PATTERN)
    for r in byte_bpe.decode(encoded, RANKS, PATTERN).collect():
        raw = (r["text"] or "").encode()
        assert bytes(r["decoded"]) == raw
        assert r["starts"] == [0, *r["ends"]][: len(r["ids"])] and (not raw or r["ends"][-1] == len(raw))
    assert encoded.limit(0).count() == 0


def test_split_characters_decode(spark, tik):
    _, decoder = byte_bpe.codec(RANKS, PATTERN)
    ids = tik.encode_ordinary("🙂")
    assert len(ids) > 1
    parts = [decoder.decode(np.array([i], "<u4").tobytes()) for i in ids]
    assert b"".join(parts).decode() == "🙂"
    with pytest.raises(UnicodeDecodeError):
        parts[0].decode()


def test_round_trip_digests(spark, tik):
    docs = docs_of(spark, [*ODD, "same", "same"], N_TOKENS="x")
    for r in byte_bpe.round_trip(docs.select("doc_id", "text", "N_TOKENS"), RANKS, PATTERN).collect():
        text = [*ODD, "same", "same"][r["doc_id"]] or ""
        ids = np.array(tik.encode_ordinary(text), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# Records


SPECIAL = ["<|endoftext|>", "a <|endoftext|>b\n<|endoftext|><|endoftext|> 🙂", "<|endoftext", "<|ENDOFTEXT|>"]


@pytest.mark.parametrize("specials_as_text", [False, True])
def test_records_round_trip(spark, tmp_path, monkeypatch, specials_as_text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    if specials_as_text:
        library.encode_special_tokens = True
    else:
        assert library.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    monkeypatch.setattr(records, "SPLIT_BYTES", 400)
    texts = [*ODD, "same", "same", *SPECIAL, "a long text " * 300]
    docs = docs_of(spark, texts, start="x", ids="y").orderBy(F.desc("doc_id"))
    folder = f"file://{tmp_path}/records"
    manifest = records.write(docs, folder, JSON, PATTERN, shards=3, specials_as_text=specials_as_text)
    assert sum(r["n_records"] for r in manifest) == len(texts)
    frame = records.read(spark, folder)
    assert frame.rdd.getNumPartitions() > len(manifest)
    found, start = sorted(frame.collect()), 0
    sums = {r["doc_id"]: r for r in records.read_checksums(spark, folder).collect()}
    for r, t in zip(found, texts, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids), ids.tobytes())
        assert sums[r["doc_id"]]["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)
    mixed = [(i, x.tolist()) for i, x in records.shuffled(folder, 1)]
    assert [i for i, _ in mixed] != sorted(i for i, _ in mixed)
    assert sorted(mixed) == [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found]


def test_shards_go_by_bytes_and_split_a_common_id(spark, tmp_path, monkeypatch):
    rows = [(7, f"text {i} of many") for i in range(400)] + [(i, "other") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert records.n_shards(docs, "text") == 1 and records.n_shards(docs.limit(0), "text") == 1
    monkeypatch.setattr(records, "SHARD_BYTES", 1000)
    assert records.n_shards(docs, "text") == -(-sum(len(t) for _, t in rows) // 1000)
    monkeypatch.setattr(records, "MANY_SHARDS", 3)
    monkeypatch.setattr(records, "LARGE_BYTES", 4000)
    assert records.n_shards(docs, "text") == max(3, -(-sum(len(t) for _, t in rows) // 4000))
    monkeypatch.setattr(records, "MANY_SHARDS", 4096)
    manifest = records.write(docs, f"{tmp_path}/r", JSON, PATTERN)
    assert len(manifest) > 6 and max(r["n_records"] for r in manifest) < 300
    found = sorted(records.read(spark, f"{tmp_path}/r").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted(i for i, _ in rows)
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found]).tolist()[:-1]]


def test_records_without_an_id_come_first_and_nothing_is_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(5, "a"), (None, "b"), (5, "a")], "doc_id long, text string")
    records.write(docs, f"{tmp_path}/r", JSON, PATTERN, shards=2)
    found = sorted(records.read(spark, f"{tmp_path}/r").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, 5, 5]
    assert records.write(docs.limit(0), f"{tmp_path}/e", JSON, PATTERN) == [] and records.read(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("at", [3, 9, 20, -2])
def test_damage_is_found(at):
    data = bytearray(records.frame(records.pack(7, np.arange(50, dtype="<u4"))) * 2)
    data[at] ^= 1
    stream = iter([bytes(data)])
    with pytest.raises(ValueError):
        list(records.frames(lambda n: next(stream, b"")))


def test_wide_ids_and_small_reads():
    packed = [records.pack(None, np.array([70000, 1], "<u4")), records.pack(3, np.array([1], "<u4"))]
    data = b"".join(map(records.frame, packed))
    fives = iter([data[i : i + 5] for i in range(0, len(data), 5)])
    found = [records.unpack(x) for x in records.frames(lambda n: next(fives, b""))]
    assert [(i, x.tolist()) for i, x in found] == [(None, [70000, 1]), (3, [1])]
