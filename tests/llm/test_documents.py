"""Fingerprints, near-duplicates, components, mixing, search, archives, pages and the pipeline."""

import hashlib
import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash
from conftest import ROOT, SMALL, same_result
from pyspark.sql import functions as F

import corpus_pipeline
from remitlens.llm import fingerprint, html_mincut, mixing, pivot_topk, queries, simhash_dedup, warc
from remitlens.llm.components import components

TEXTS = [None, "", " \t ", "one", "one two", "The cat sat on the mat. " * 40, "The cat sat on the mat. " * 40, "Äpfel und Birnen, " * 30, "x " * 3000, "🙂 a🙂b c"]


def docs_of(spark, texts, more="", *values):
    return spark.createDataFrame([(i, t, *values) for i, t in enumerate(texts)], "doc_id long, text string" + more)


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


# Fingerprints


def terms_print(text):
    words = text.lower().split() if text.strip() else []
    pairs = [*zip(words, words[1:], strict=False), *([(words[-1], None)] if words else [])]
    return majority([xx(a.encode()) if b is None else xx(b.encode(), xx(a.encode())) for a, b in pairs])


def test_fingerprints_and_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    texts = [*TEXTS, *(f"word{i} and {i % 3} more words" for i in range(20))]
    docs = docs_of(spark, texts, ", row int, key string, bucket string", 1, "k", "b")
    found = {r["doc_id"]: r for r in fingerprint.edited_likeness(docs).collect()}
    assert len(found) == len(texts)
    prints = [terms_print(t or "") for t in texts]
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r, e = found[i], terms_print(edited)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{prints[i]:016x}", f"{e:016x}")
        assert r["near_edited"] == pytest.approx(1 - (prints[i] ^ e).bit_count() / 64)
        assert r["near_next"] == pytest.approx(1 - (prints[i] ^ prints[(i + 1) % len(texts)]).bit_count() / 64)
        assert r["n_near"] == sum(0 < (p ^ prints[i]).bit_count() <= 3 for p in set(prints))


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    one = fingerprint.edited_likeness(spark.createDataFrame([(7, "abcdefgh")], schema)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1
    odd = spark.createDataFrame([(None, "n"), (5, "b"), (5, "a"), (5, "a")], schema)
    assert fingerprint.edited_likeness(odd).count() == 4
    assert fingerprint.edited_likeness(odd.limit(0)).count() == 0


def test_a_common_id_is_dealt_to_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 4)
    rows = [(None, f"nobody's text {i}") for i in range(30)] + [(7, f"seventh {i}") for i in range(25)] + [(i, f"own text {i}") for i in range(20)] + [(7, "seventh 3"), (19, "own text 19")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    chain = fingerprint.with_next(docs).collect()
    assert max(Counter(r["row"] >> 40 for r in chain).values()) <= 12
    following = {r["row"]: r for r in chain}
    at, seen = min(following), []
    for _ in rows:
        r = following[at]
        assert r["next_text"] == following[r["next_row"]]["text"]
        seen.append((r["doc_id"], r["text"]))
        at = r["next_row"]
    assert at == min(following) and sorted(seen, key=repr) == sorted(rows, key=repr)
    ids = [-1 if i is None else i for i, _ in seen]
    assert ids == sorted(ids)


@pytest.mark.parametrize("crowd", [1024, 2])
@pytest.mark.parametrize("radius", [0, 3, 5])
def test_block_tables_miss_nothing(spark, monkeypatch, radius, crowd):
    monkeypatch.setattr(fingerprint, "KEY_ROWS", crowd)
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    all_ = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in range(7)}
    signed = [x - 2**64 if x >= 2**63 else x for x in all_]
    df = spark.createDataFrame([(x,) for x in [*signed, signed[0], None]], "print long")
    found = [(r["query"] % 2**64, r["print"] % 2**64) for r in fingerprint.near(df, df, radius).collect()]
    apart = [(r["query"] % 2**64, r["print"] % 2**64) for r in fingerprint.near(df, df.limit(30), radius).collect()]
    assert len(set(found)) == len(found) and set(apart) <= set(found)
    assert {(a, b) for a, b in found if a in {x % 2**64 for x in signed[:30]}} >= set(apart) and set(found) == {(a, b) for a, b in product(all_, all_) if 0 < (a ^ b).bit_count() <= radius}


def test_fingerprint_plan_runs_no_python(spark):
    docs = fingerprint.with_next(docs_of(spark, TEXTS))
    plan = fingerprint.simhash(docs, ["row"], "text")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "InMap"))


# Near-duplicates


def brute_groups(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_print(text, size=3):
    words = (text or "").encode().lower().split()
    size = min(size, len(words))
    return majority([xx(b" ".join(words[i : i + size])) for i in range(len(words) - size + 1)]) if words else 0


def test_groups_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(40)]
    texts = [*TEXTS, *base, *base[:10], *(b + " end" for b in base), *(b.upper() for b in base[:5])]
    docs = docs_of(spark, texts, ", fingerprint string, component_id long", "x", 1)
    prints = {i: shingle_print(t) for i, t in enumerate(texts)}
    expected = brute_groups(prints, 2)
    for r in simhash_dedup.groups(simhash_dedup.fingerprints(docs), 2).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", expected[r["doc_id"]])


@pytest.mark.parametrize("lanes", [1, 4])
@pytest.mark.parametrize("similarity", [0.0, 0.8])
def test_tiles_lose_no_link(spark, monkeypatch, lanes, similarity):
    monkeypatch.setattr(simhash_dedup, "TILE_ROWS", (16, 1 << 20))
    monkeypatch.setattr(simhash_dedup, "TILES", 5)
    monkeypatch.setattr(simhash_dedup, "BLOCK", 4)
    rng = random.Random(lanes)
    width, radius = 64 * lanes, 3 * lanes
    bases = [rng.getrandbits(width) for _ in range(25)]
    prints, sizes = {}, {}
    for i in range(150):
        bits = rng.sample(range(width), rng.randint(0, 2 * lanes))
        prints[i], sizes[i] = bases[i % 25] ^ sum(1 << b for b in bits), 100
    rows = [(i, f"{p:0{width // 4}x}", sizes[i]) for i, p in prints.items()]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string, n_shingles long")
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.groups(df, radius, similarity).collect()}
    assert found == brute_groups(prints, radius)


def test_a_large_group_leaves_a_task_as_a_forest():
    prints = np.arange(1 << 9, dtype=np.uint64).reshape(-1, 1)  # all joined by single bits
    a, b = simhash_dedup.compare_tiles(prints, np.ones(512, int), np.zeros(512, int), 2, 0.0)
    assert len(a) == 511 and set(b.tolist()) == {0}


def test_dedup_of_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(None, "only null"), (None, "both"), (4, "both"), (9, ""), (8, None)], "doc_id long, text string")
    found = simhash_dedup.groups(simhash_dedup.fingerprints(docs), 2)
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found.collect()) == [(-1, -1), (-1, 4), (4, 4), (8, 8), (9, 8)]
    none = simhash_dedup.groups(simhash_dedup.fingerprints(docs.limit(0)), 2)
    assert none.count() == 0 and simhash_dedup.keep_one(docs.limit(0), none).count() == 0


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, "other words here", None)], "doc_id long, text string, component_id string")
    grouped = simhash_dedup.groups(simhash_dedup.fingerprints(docs), 2)
    assert sorted(r["doc_id"] for r in simhash_dedup.keep_one(docs, grouped).collect()) == [1, 3]


def test_null_and_shared_ids_lose_no_text(spark):
    far = "these are quite other words, of another document"
    rows = [(None, "only null"), (None, "only null"), (None, "a third text of nobody"), (None, "both"), (4, "both"), (7, "first text of seven"), (7, far), (2, far), (9, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    expected = sorted([(-1, "only null"), (-1, "a third text of nobody"), (4, "both"), (7, "first text of seven"), (2, far), (9, "")])
    by_bits = simhash_dedup.keep_one(docs, simhash_dedup.groups(simhash_dedup.fingerprints(docs), 2))
    for kept in (by_bits, corpus_pipeline.near_duplicates(spark, docs, SMALL)):
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept.collect()) == expected


def test_components_of_a_long_chain_and_a_star(spark):
    names = [f"n{i:03d}" for i in range(120)]
    order = names[:]
    random.Random(0).shuffle(order)
    edges = [*zip(order, order[1:], strict=False), *(("s000", f"s{i:03d}") for i in range(50)), ("l", "l"), ("m", None)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len(found) == 170 and len({found[n] for n in names}) == 1 and len(set(found.values())) == 2
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


# Mixing


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    targets = mixing.water_fill([1000, 10, 0, 50], [1, 5, 2, 3])
    assert targets == pytest.approx([880, 30, 0, 150]) and sum(targets) == pytest.approx(1060)
    assert mixing.water_fill([], []) == []


@pytest.mark.parametrize("seed", range(8))
def test_sainte_lague_takes_highest_quotients(seed):
    rng = random.Random(seed)
    claims = [rng.choice([0, 1, 7, 1000 * rng.random()]) for _ in range(9)]
    most, seats = [rng.randint(0, 40) for _ in claims], rng.randint(0, 150)
    held = [0] * len(claims)
    for _ in range(min(seats, sum(most))):
        i = max((i for i in range(len(claims)) if held[i] < most[i]), key=lambda i: (claims[i] / (2 * held[i] + 1), -i))
        held[i] += 1
    assert mixing.sainte_lague(claims, seats, most) == held


def mixture_docs(spark, n=300):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(0, 400)), ["a", "b", None, "", "big"][min(4, i % 9)], i) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "a", 0), (n + 1, "x y", "noneé", 1), (n + 1, "x y", "noneé", 1)], "doc_id long, text string, source string, size int")


@pytest.mark.parametrize("parts", [1, 6])
def test_mix_is_near_its_targets(spark, monkeypatch, parts):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 5000)
    docs = mixture_docs(spark).repartition(parts)
    found = mixing.plan(docs).collect()
    assert len(found) == 303 and all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    by = {}
    for r in found:
        at = by.setdefault((r["source_size"], r["target"]), [0, 0])
        at[0] += r["size"]
        at[1] += r["taken"]
    for (size, target), (total, taken) in by.items():
        assert size == total and abs(taken - target) <= max(4, 3 * mixing.BLOCK_WORDS)
    assert hashlib.md5(repr(sorted((r["doc_id"], r["taken"]) for r in found)).encode()).hexdigest() == _mix_digest(spark)


def naive_seats(claims, seats, most):
    held = [0] * len(claims)
    for _ in range(min(seats, sum(most))):
        k = max((i for i in range(len(claims)) if held[i] < most[i]), key=lambda i: (claims[i] / (2 * held[i] + 1), -i))
        held[k] += 1
    return held


@pytest.mark.parametrize("shard_words", [2000, 1 << 18])
def test_mix_against_brute_force(spark, monkeypatch, shard_words):
    """Words taken one block at a time; only Spark's hashes, which order documents, are taken as given."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
    docs = mixture_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    seed = F.lit(mixing.SEED)
    hashed = docs.select("*", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h"))
    hashed = hashed.select("*", F.pmod(F.xxhash64("h", seed), F.lit(mixing.BUCKETS)).alias("b"), F.xxhash64("h", seed + 1).alias("o")).collect()
    size = {r["doc_id"]: len([w for w in (r["text"] or "").encode().split()]) for r in hashed}
    sources = sorted({r["source"] for r in hashed}, key=lambda x: (x is None, x or ""))
    totals = [sum(size[r["doc_id"]] for r in hashed if r["source"] == x) for x in sources]
    targets = mixing.water_fill(totals, [1 + i % 3 for i in range(len(sources))])
    block = mixing.block_words(targets)
    blocks_of = [-(-t // block) for t in totals]
    seats = naive_seats(targets, round(sum(targets) / block), [3 * n for n in blocks_of])
    taken = dict.fromkeys(size, 0)
    for x, total, quota in zip(sources, totals, seats, strict=True):
        shards = 1
        while shards * shard_words < total:
            shards *= 2
        members = [[r for r in hashed if r["source"] == x and r["b"] % shards == k] for k in range(shards)]
        held = [k for k in range(shards) if members[k]]
        words = [[i for r in sorted(members[k], key=lambda r: (r["o"], r["doc_id"])) for i in [r["doc_id"]] * size[r["doc_id"]]] for k in held]
        share = naive_seats([len(w) for w in words], quota, [3 * -(-len(w) // block) for w in words])
        for k, of, q in zip(held, words, share, strict=True):
            n = -(-len(of) // block)
            if not n:
                continue
            (first,) = spark.range(1).select(F.pmod(F.xxhash64(F.lit(x).cast("string"), F.lit(k).cast("long"), seed + 2), F.lit(n).cast("long"))).first()
            for j in range(q):
                at = (first + j) % n
                for i in of[at * block : (at + 1) * block]:
                    taken[i] += 1
    found = {r["doc_id"]: r for r in mixing.plan(docs).collect()}
    assert {i: r["taken"] for i, r in found.items()} == taken and {i: r["size"] for i, r in found.items()} == size


def test_sizes_and_targets_equal_sql(spark, duck):
    """What SQL can express of the mix; its sources' targets stop once at three times their size and no more than that here."""
    sql = r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
    f AS (SELECT *, weight * (SELECT sum(source_size) FROM s) / sum(weight) OVER () AS share FROM s),
    c AS (SELECT *, share > 3 * source_size AS over FROM f),
    t AS (SELECT source, source_size, CASE WHEN over THEN 3.0 * source_size ELSE weight * ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) FILTER (WHERE over) OVER (), 0))
          / sum(weight) FILTER (WHERE NOT over) OVER () END AS target FROM c)
    SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""
    assert same_result(queries.op9_mixing(spark, SMALL).select("doc_id", "size", "source_size", "target"), duck, sql)


def test_small_sources_and_missing_ids_are_mixed_as_others(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    rows = [(None, "big", f"words of a document number {i} " * 9) for i in range(300)] + [(1, "a tiny", "five words are all here"), (1, "a tiny", "two more"), (2, None, "one")]
    rows += [(3, "long", "a very long text " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.plan(docs, keep=("doc_id", "source")).collect()
    for x in ("a tiny", None, "big", "long"):
        of = [r for r in found if r["source"] == x]
        assert sum(r["taken"] for r in of) == pytest.approx(of[0]["target"], abs=4)
    taken = [r["taken"] for r in found if r["source"] == "big"]
    assert max(taken) > 0 and sum(t > 0 for t in taken) * 3 * 54 >= sum(taken)
    again = mixing.plan(docs.repartition(5), keep=("doc_id", "source")).collect()
    assert Counter(map(tuple, ((r["source"], r["size"], r["taken"]) for r in again))) == Counter(map(tuple, ((r["source"], r["size"], r["taken"]) for r in found)))


def _mix_digest(spark, kept={}):  # noqa: B006
    if not kept:
        found = mixing.plan(mixture_docs(spark)).collect()
        kept["digest"] = hashlib.md5(repr(sorted((r["doc_id"], r["taken"]) for r in found)).encode()).hexdigest()
    return kept["digest"]


def test_mixed_documents_hold_the_taken_words(spark):
    docs = mixture_docs(spark)
    taken = {}
    for r in mixing.plan(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    mixed = mixing.apply(docs)
    assert mixed.columns == docs.columns
    held = {}
    for r in mixed.collect():
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in held.items() if n}
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.apply(docs.limit(0)).count() == 0


# Search


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "CELL_ROWS", 16)
    monkeypatch.setattr(pivot_topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=8).round(2).tolist() for i in range(150)}
    vectors |= {i: [0.5] * 8 for i in range(150, 260)}  # ties at one distance
    vectors |= {260: [], 261: [1.0, -2.0], 262: [30.0] * 8}
    rows = [(i, v, "x") for i, v in vectors.items()]
    rows += [rows[20], rows[20], rows[21], (40, [0.25] * 8, "x"), (40, [0.25] * 8, "x")]  # repeated rows, and one vec_id of several vectors
    valid = rows[:]
    rows += [(300, None, "x"), (320, [1.0, None], "x"), (340, [float("nan")] * 8, "x"), (360, [float("inf")] * 8, "x"), (None, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in valid]
    expected = []
    for n, (q, own) in enumerate(whole):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for m, (i, v) in enumerate(whole) if m != n)
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:20])]
    found = pivot_topk.top_k(df, F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_rows_dealt_grow_with_visits(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "CELL_ROWS", 16)
    monkeypatch.setattr(pivot_topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6)) * 5
    rows = [(i, (centres[i % 8] + rng.normal(size=6) * 0.1).round(3).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    dealt, own = [], pivot_topk.Index._dealt

    def counted(self, blocks):
        dealt.append((own(self, blocks).count(), self.keyed.count(), int(blocks.max())))
        return own(self, blocks)

    monkeypatch.setattr(pivot_topk.Index, "_dealt", counted)
    pivot_topk.top_k(df, F.col("vec_id") % 160 == 0, k=3).collect()  # all queries are of one cluster
    (first, n, _), (second, _, blocks) = dealt
    assert first < n / 4 and second < n and blocks >= 1


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    found = pivot_topk.top_k(df, F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 1, 8192), (0, 2, 2, 8192)]
    for few in (df.where("vec_id = 0"), df.where("vec_id > 0"), df.limit(0)):
        assert pivot_topk.top_k(few, F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [3e7, 1.0]), (3, [-3e7, 0.0])], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in pivot_topk.top_k(df, F.col("vec_id") == 0).collect())
    big = (64 * 30000000) ** 2
    assert found == [(0, 1, 1, big + 64 * 128), (0, 2, 2, big + 64 * 64), (0, 3, 3, -big)]


# Archives


def pages_of(spark):
    rng = random.Random(5)
    bodies = ["<p>" + "".join(rng.choices("abcdefé🙂 \n", k=rng.randint(0, 3000))) + "</p>" for _ in range(30)]
    rows = [(i, f"http://x/{i}?a=%20 b\r\n", bodies[i % 30]) for i in range(70)]
    rows += [(100, None, None), (101, "u", ""), (102, "", ""), (None, "n", bodies[0]), (None, "n", "alone"), (None, "n", "alone"), (69, "again", bodies[9])]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string"), rows


@pytest.mark.parametrize("min_bytes", [0, 1, 1500])
def test_archives_round_trip(spark, tmp_path, min_bytes):
    pages, rows = pages_of(spark)
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    expected = []
    for i, url, html in rows:
        payload = (html or "").encode()
        to = largest.get(html or "")
        refers = to if len(payload) >= min_bytes and to is not None and i != to else None
        expected.append((i, url or "", len(payload), warc.payload_digest(payload), "response" if refers is None else "revisit", refers, None if refers is not None else payload))
    folder = f"{tmp_path}/w"
    warc.write(pages.repartition(3), folder, min_bytes)
    for split in (97, 1000, 1 << 20):
        found = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.read(spark, folder, payload=True, split_bytes=split).collect()]
        assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_payloads_longer_than_a_read(spark, tmp_path):
    rng = random.Random(8)
    long = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz<>é \n", k=3 * warc.READ_BYTES)) for _ in range(2)]
    pages = spark.createDataFrame([(1, "u", long[0], 1), (2, "u", long[0], 1), (3, "u", long[1], 1), (4, "u", "short", 1)], "page_id long, url string, html string, payload_bytes int")
    warc.write(pages.coalesce(1), f"{tmp_path}/w")
    found = {r["page_id"]: r for r in warc.read(spark, f"{tmp_path}/w", payload=True, split_bytes=1 << 18).collect()}
    assert [found[i]["record_type"] for i in range(1, 5)] == ["revisit", "response", "response", "response"] and found[1]["refers_to"] == 2
    assert bytes(found[2]["payload"]).decode() == long[0] and bytes(found[3]["payload"]).decode() == long[1] and found[1]["payload_bytes"] == len(long[0].encode())


def test_no_folder_of_one_machine_stands_in_on_a_cluster():
    from types import SimpleNamespace as Fake

    from remitlens.llm import common

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master=master)))


def test_operators_reach_workers_without_the_entry(tmp_path):
    """Frames of one's own, a driver started elsewhere."""
    import os
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from remitlens.llm import simhash_dedup
df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "other")], "doc_id long, text string")
print(sorted(r["component_id"] for r in simhash_dedup.groups(simhash_dedup.fingerprints(df), 2).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=env, capture_output=True, text=True, timeout=200)
    assert done.stdout.strip() == "[1, 1, 3]", done.stderr[-2000:]


def test_archives_of_nothing(spark, tmp_path):
    pages, _ = pages_of(spark)
    assert warc.write(pages.limit(0), f"{tmp_path}/w") == [] and warc.read(spark, f"{tmp_path}/w").count() == 0


def test_a_false_mark_is_no_record(tmp_path):
    made = warc.record(1, "u", b"x", None, False)
    path = tmp_path / "a"
    path.write_bytes(warc.MAGIC + b"junk" + made + warc.MAGIC + made)
    with path.open("rb") as f:
        assert len(list(warc.members(f, 0, path.stat().st_size))) == 2
    path.write_bytes(made[:-3])
    with path.open("rb") as f, pytest.raises(ValueError):
        list(warc.members(f, 0, 10))


# Pages


@pytest.mark.parametrize("seed", range(30))
def test_minimum_cut_against_enumeration(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    odds = [rng.uniform(-3, 3) for _ in range(n)]
    edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

    def cost(side):
        return sum(max(o, 0) if not s else max(-o, 0) for o, s in zip(odds, side, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])

    least = min(cost(s) for s in product((True, False), repeat=n))
    assert cost(html_mincut.content_side(odds, edges)) == pytest.approx(least)
    assert cost(html_mincut.max_flow_side(odds, edges)) == pytest.approx(least)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>Alpha</a><li><a href=/b>Beta</a></ul></nav>
<div class="cookie-notice">We use cookies on this site. Please accept them all.</div>
<article><h1>The  title</h1><p>First &amp; <b>bold</b>
 text&nbsp;here, of some length.<p>Second<br>paragraph.<!-- no --><script>x()</script>
<div class="ad">Buy this now, it is the best thing ever made!</div><ul><li>A point that is made.</li></ul>
<form><input><label>Your mail</label><button>Send</button></form></article>
<aside>Other stories</aside><section id="comments"><p>I think that this article is wonderful, really.</p></section>
<footer>&copy; 2024 Site</footer></body></html>"""


def test_main_text():
    assert html_mincut.main_text(PAGE) == "The title\n\nFirst & bold text here, of some length.\n\nSecond paragraph.\n\nA point that is made."


LONG = "This is a long paragraph of the article, which tells in plain words what has happened, and to whom, and when it was."


@pytest.mark.parametrize(
    "page",
    [
        *(f"<div class='{c}'><article><p>{LONG}</p></article><div class=sidebar><p>{LONG[5:]}</p></div></div>" for c in ("has-sidebar", "no-sidebar", "layout with-navigation", "elementor-widget", "widget", "content-sidebar-wrap")),
        *(f"<article class='{c}'><p>{LONG}</p></article>" for c in ("post category-social", "post tag-login", "social")),
        f"<article><section id='search-engines'><p>{LONG}</p></section></article>",
        f"<div class='elementor-widget'><div class='elementor-widget-container'><p>{LONG}</p></div></div>",
        f"<body class='no-sidebar'><div class='page has-sidebar'><p>{LONG}</p></div></body>",
        f"<article><p>{LONG}</p></article><ol class='comment-list'><li><article class='comment-body'><p>{LONG[5:]}</p></article></li></ol>",
        f"<article><p>{LONG}</p></article><div class='related-posts'><article><p>{LONG[5:]}</p></article></div>",
        *(f"<article><p>{LONG}</p></article><div class='{c}'><p>{LONG[5:]}</p></div>" for c in ("site-footer", "main-nav", "left_sidebar", "shareButtons", "cookie-notice", "widget-2")),
    ],
)
def test_names_of_wrappers_lose_no_article(page):
    assert html_mincut.main_text(page) == LONG


SHORT = "A point."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<form action=/post><input type=hidden name=x><nav><a href=/>Home</a></nav><div class=content><h1>A title of it</h1><p>{LONG}</p><p>{LONG}</p></div><input name=q></form>", f"A title of it\n\n{LONG}\n\n{LONG}"),
        (f"<form><article><p>{LONG}</p></article></form>", LONG),
        (f"<article><p>{LONG}</p><form><p>Your mail, please:</p><input name=mail><button>Send it now</button></form></article>", LONG),
        (f"<div class='content menu-open'><p>{LONG}</p></div>", LONG),
        ("<article><p>Take <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> as it is, which suffices.</p></article>", "Take x=2 as it is, which suffices."),
        (f"<article><h2 id='comments-on-method'>Comments on method</h2><p>{LONG}</p></article>", f"Comments on method\n\n{LONG}"),
        (f"<article><p>{LONG[:60]}<script>x('</p>')</script>{LONG[60:]}</p></article>", LONG),
        (f"<article><p>{LONG}</p><ul><li><a href=/x>A link of the text</a></li><li>{SHORT}</li></ul><p>{LONG}</p></article>", f"{LONG}\n\nA link of the text\n\n{SHORT}\n\n{LONG}"),
        (f"<div><ul><li><a href=/a>Alpha</a></li><li><a href=/b>Beta</a></li></ul></div><div><h1>A title of it</h1><p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p></div><div>© 2024 Site</div>", f"A title of it\n\n{LONG}\n\n{SHORT}\n\n{LONG}"),
        (f"<article><header><h1>A title of it</h1></header><p>{LONG}</p><footer><a href=/t>Tag</a></footer></article>", f"A title of it\n\n{LONG}"),
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><div><p>{LONG[3:]}</p></div>", f"{LONG}\n\n{LONG}"),
        (f"<div><article><p>{SHORT}</p></article><div><p>{LONG}</p><p>{LONG}</p></div></div>", f"{SHORT}\n\n{LONG}\n\n{LONG}"),
        (f"<main><p>{LONG}</p><section class=comments><h3>Comments</h3><p>{LONG[3:]}</p></section></main>", LONG),
    ],
)
def test_main_text_of_odd_markup(page, text):
    assert html_mincut.main_text(page) == text


def stripped(page):
    """The page with nothing that tells its elements apart but paragraphs, headings and lists."""
    import re

    return re.sub(r"<(/?)(?:article|nav|footer|header|aside|main|section|div)[^>]*>", r"<\1div>", page)


def test_the_cut_takes_what_its_sign_would_not():
    page = html_mincut.Page(f"<div><p>{LONG}</p><div>Ah.</div><p>{LONG}</p></div><div><a href=/a>Alpha</a></div>")
    odds = html_mincut.text_odds(page.blocks, html_mincut.FALLBACK)
    side = html_mincut.content_side(odds, html_mincut.smoothness(page))
    assert [o > 0 for o in odds] == [True, False, True, False] and side == [True, True, True, False]


def test_cuts_of_stripped_pages_are_least():
    for r in first_rows("pages"):
        page = html_mincut.Page(stripped(r["html"])[:2600])
        page.blocks = page.blocks[:11]
        odds = [a + b for a, b in zip(html_mincut.text_odds(page.blocks, html_mincut.FALLBACK), page.evidence, strict=False)]
        edges = html_mincut.smoothness(page)

        def cost(side):
            return sum(max(o, 0) if not s else max(-o, 0) for o, s in zip(odds, side, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])

        least = min(cost(s) for s in product((True, False), repeat=len(odds)))
        assert cost(html_mincut.content_side(odds, edges)) == pytest.approx(least)


def first_rows(name, n=25):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SMALL}/{name}.parquet").slice(0, n).to_pylist()


def test_stripped_pages_give_their_article_by_what_others_teach(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights = html_mincut.fit(pages)
    assert not np.array_equal(weights, html_mincut.FALLBACK) and np.array_equal(weights, html_mincut.fit(pages.repartition(3)))
    assert np.array_equal(html_mincut.fit(pages.limit(0)), html_mincut.FALLBACK)
    same = [html_mincut.main_text(stripped(r["html"]), weights) == html_mincut.main_text(r["html"], weights) for r in pages.collect()]
    assert np.mean(same) >= 0.95  # an advert of several sentences in a plain element may pass for text


def test_odd_pages(spark):
    htmls = [None, "", "just text", "<p>a<p>b", "<" * 500, "<div>" * 3000 + "deep", "<p>" * 3000 + "x", PAGE, PAGE]
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, h in enumerate(htmls)], "page_id long, url string, html string, TEXT string")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_mincut.extract(df).collect()}
    assert found[0] == found[1] == ("", 0) and found[2] == ("just text", 9) and found[7] == found[8] and found[3][0] == "a\n\nb"
    assert all(n == len(t) for t, n in found.values())
    assert html_mincut.extract(df.limit(0)).count() == 0


def test_pages_give_their_article(spark):
    import html
    import re

    for r in queries.op10_html_text(spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", inside))
        assert r["text"] == "\n\n".join(b for b in blocks if b)


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, duck, name):
    assert same_result(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0), (90003, "dup text here of words", "en", "src1", 9), (90003, "dup text here of words", "en", "src1", 9)], docs.schema)
    docs = docs.union(odd)
    kept = corpus_pipeline.quality(spark, docs, SMALL)
    assert kept.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    good, bad = ({i for i, q in labels.items() if q == v} for v in (1, 0))
    assert len(good & ids) >= 0.98 * len(good) and len(bad & ids) <= 0.1 * len(bad)
    single = corpus_pipeline.near_duplicates(spark, kept, SMALL)
    assert single.columns == docs.columns and single.count() == single.select("doc_id").distinct().count()
    texts = [r["text"] for r in single.collect()]
    assert len(set(texts)) == len(texts)
    mixed = corpus_pipeline.mixture(spark, single, SMALL)
    assert mixed.columns == docs.columns
    last = corpus_pipeline.tokens(spark, mixed, SMALL)
    assert last.where("not round_trips").count() == 0 and last.count() == mixed.count()
    assert corpus_pipeline.tokens(spark, docs.limit(0), SMALL).count() == 0


def test_near_duplicates_catch_near_copies_and_leave_the_rest(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(2000)]
    base = [rng.choices(words, k=300) for _ in range(30)]
    near = [[*b[:150], "changed", *b[151:]] for b in base]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate([*base, *near])], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30))


def similar_texts(rng, changed, union=400):
    """Two texts without repeated words whose sets of five-word shingles have the similarity (union - 2 * changed) / union."""
    words = [f"w{rng.getrandbits(60):x}" for _ in range(union - changed + 4)]
    return " ".join(words), " ".join([*words[: len(words) - changed], *(f"c{rng.getrandbits(60):x}" for _ in range(changed))])


def test_near_duplicates_are_decided_by_their_shingles(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "VERIFY_ROWS", 1)
    rng = random.Random(6)
    texts, linked = [], {}
    for changed in (60, 50, 41, 40, 30):  # similarities 0.7, 0.75, 0.795, 0.8, 0.85
        for _ in range(25):
            linked[len(texts)] = changed <= 40
            texts += similar_texts(rng, changed)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {i for i in range(len(texts)) if i % 2 == 0 or not linked[i - 1]}


def test_near_duplicates_with_repeated_passages(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(10):
        a, b = similar_texts(rng, 10)
        texts += [a, " ".join([b] * 6)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 20, 2))


def test_equal_fingerprints_of_unlike_sizes_link_by_either(spark):
    rows = [(1, "00", 100), (2, "00", 400), (3, "01", 390), (4, "03", 50)]
    df = spark.createDataFrame([(i, p.zfill(16), n) for i, p, n in rows], "doc_id long, fingerprint string, n_shingles long")
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.groups(df, 1, 0.8).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("seed", range(6))
def test_similar_pairs_against_brute_force(seed):
    rng = random.Random(seed)
    sets = [np.unique(np.array(rng.sample(range(14), rng.randint(1, 12)), np.uint64)) for _ in range(60)]
    part = np.array([rng.randrange(2) if seed % 2 else 0 for _ in sets])
    a, b = simhash_dedup.similar_pairs(sets, part, 0.8)
    plain = [set(s.tolist()) for s in sets]
    near = lambda i, j: len(plain[i] & plain[j]) / len(plain[i] | plain[j]) >= 0.8 and (part[i] != part[j] or not part.any())
    assert all(near(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True))

    def grouped(pairs):
        label = list(range(60))
        for i, j in pairs:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k in range(60) if label[k] == x) for x in label}

    assert grouped(zip(a.tolist(), b.tolist(), strict=True)) == grouped((i, j) for i in range(60) for j in range(i) if near(i, j))


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixture", "tokens"]
