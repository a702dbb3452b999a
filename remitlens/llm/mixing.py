"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

A source's target is its share by weight of all words, but at most
``MAX_REPEATS`` times its own; what is above goes to the others by weight. Targets
are apportioned in whole blocks of ``BLOCK_WORDS`` words, or of fewer if the least target
would have under ``LEAST_BLOCKS`` of them, so a small source is taken too: each next block
goes to the source with the highest quotient target / (2 * blocks + 1). A source's
documents are dealt by hash into shards of about ``SHARD_WORDS`` words, and its
blocks are apportioned to its shards in the same way. In a shard the documents
stand in seeded random order and their words are cut into blocks; every block is
taken quota // blocks times, and quota % blocks of them, from a seeded place on,
once more. No document is taken more than ``MAX_REPEATS`` times.

A large source has many shards, at most ``BUCKETS``, so no task holds a whole source;
one task apportions a source's blocks to its shards, and a row for each source comes to the
driver. Null texts have size 0 and texts of any length count whole; a null source is a
source of its own, last in order; sources without words have target 0. Documents are
dealt and ordered by doc_id and text, so those that have no doc_id or share one are dealt
as others are. Repeated rows are repeated documents. Reruns give equal results, whatever the
partitioning. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.llm.common import WORD, cut, importable, text_or_empty

WEIGHTS, MAX_REPEATS = (1, 2, 3), 3
BLOCK_WORDS, LEAST_BLOCKS, SHARD_WORDS, SEED = 32, 16, 1 << 18, 20240
#: Fine buckets of each source, of which shards are made.
BUCKETS = 1 << 16


def water_fill(sizes: Sequence[float], weights: Sequence[float], most: float = MAX_REPEATS) -> list[float]:
    """Targets that share the sum of sizes by weight, none above ``most`` times its size."""
    targets, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def sainte_lague(claims: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients claim / (2 * held + 1), ties to the first; none above its ``most``.

    A divisor found by bisection gives nearly all seats at once; the rest go one by one.
    """
    seats = min(seats, sum(most))
    low, high = 1e-9, max([1.0, *(2 * c + 1 for c in claims)])

    def by(divisor: float) -> list[int]:
        return [min(m, math.floor(c / divisor + 0.5)) for c, m in zip(claims, most, strict=True)]

    for _ in range(200):
        middle = (low + high) / 2
        if sum(by(middle)) > seats:
            low = middle
        else:
            high = middle
    held = by(high)
    queue = [(-c / (2 * h + 1), i) for i, (c, h, m) in enumerate(zip(claims, held, most, strict=True)) if h < m]
    heapq.heapify(queue)
    for _ in range(seats - sum(held)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        held[i] += 1
        if held[i] < most[i]:
            heapq.heappush(queue, (-claims[i] / (2 * held[i] + 1), i))
    return held


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def block_words(targets: Sequence[float]) -> int:
    """Words of a block, so that every target has enough of them."""
    least = min((t for t in targets if t > 0), default=0)
    return int(max(1, min(BLOCK_WORDS, least // LEAST_BLOCKS)))


def _source_plan(totals: list, weights: Sequence[float]) -> list[tuple]:
    """Rows (source, source_size, target, seats, shards, block) from rows (source, source_size)."""
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["source_size"] for r in totals]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    block = block_words(targets)
    seats = sainte_lague(targets, round(sum(targets) / block), [MAX_REPEATS * math.ceil(s / block) for s in sizes])
    shards = [min(BUCKETS, 1 << max(0, math.ceil(math.log2(max(s, 1) / SHARD_WORDS)))) for s in sizes]
    return [(r["source"], s, t, q, n, block) for r, s, t, q, n in zip(totals, sizes, targets, seats, shards, strict=True)]


def _shard_seats(rows: pd.DataFrame) -> pd.DataFrame:
    """The blocks of each shard of one source."""
    rows = rows.sort_values("shard")
    sizes, seats, block = rows["shard_size"].tolist(), int(rows["seats"].iloc[0]), int(rows["block"].iloc[0])
    held = sainte_lague(sizes, seats, [MAX_REPEATS * math.ceil(s / block) for s in sizes])
    return rows.assign(quota=held)[["source", "shard", "shard_size", "quota", "source_size", "target", "block"]]


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The mix: the columns ``keep``, ``size``, ``source_size``, ``target``, ``copies``, ``spans``, ``taken``.

    ``copies`` times the whole document is taken, and the words in ``spans``, an
    array of (start, end) in words of the document, once more. Only the sources'
    totals, one row a source, come to the driver.
    """
    spark = docs.sparkSession
    importable(spark)
    of_text = F.xxhash64("doc_id", text_or_empty(text)).alias("of_text")
    sized = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, "doc_id", "source"])), n_words(text).alias("size"), of_text)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("of_text", F.lit(SEED)), F.lit(BUCKETS)))
    fine = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    totals = fine.groupBy("source").agg(F.sum("words").alias("source_size")).collect()
    sources = spark.createDataFrame(_source_plan(totals, weights), "source string, source_size long, target double, seats long, shards long, block long")

    def with_source(df: DataFrame, other: DataFrame, *more: str) -> DataFrame:
        on = F.col("l.source").eqNullSafe(F.col("r.source"))
        for c in more:
            on &= F.col(f"l.{c}") == F.col(f"r.{c}")
        return df.alias("l").join(other.alias("r"), on).select("l.*", *(f"r.{c}" for c in other.columns if c not in {"source", *more}))

    shard = F.pmod("bucket", "shards")
    shards = with_source(fine, sources).withColumn("shard", shard)
    shards = shards.groupBy("source", "shard", "source_size", "target", "seats", "block").agg(F.sum("words").alias("shard_size"))
    quotas = shards.groupBy("source").applyInPandas(_shard_seats, "source string, shard long, shard_size long, quota long, source_size long, target double, block long")
    quotas = cut(quotas)

    dealt = with_source(sized, sources.select("source", "shards")).withColumn("shard", shard).drop("shards", "bucket")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("of_text", F.lit(SEED + 1)), "doc_id", "of_text", "size")
    placed = dealt.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = with_source(placed, quotas, "shard").withColumn("start", F.col("end") - F.col("size"))

    blocks = F.ceil(F.col("shard_size") / F.col("block"))
    first = F.pmod(F.xxhash64("source", "shard", F.lit(SEED + 2)), F.greatest(blocks, F.lit(1)))
    placed = placed.withColumn("blocks", blocks).withColumn("first", first).withColumn("copies", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long"))
    over = F.col("first") + F.col("quota") - F.col("copies") * F.col("blocks")
    placed = placed.withColumn("over", over)
    placed = placed.withColumn(
        "spans",
        F.filter(
            F.array(
                _overlap(F.col("first") * F.col("block"), F.least("over", "blocks") * F.col("block")),
                _overlap(F.lit(0).cast("long"), (F.col("over") - F.col("blocks")) * F.col("block")),
            ),
            lambda s: s["end"] > s["start"],
        ),
    )
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    placed = placed.withColumn("taken", F.col("copies") * F.col("size") + extra)
    return placed.select(*(F.col(f"`{c}`") for c in keep), "size", "source_size", "target", "copies", "spans", "taken")


def _overlap(low: Column, high: Column) -> Column:
    """The words of the document, counted from its first, that lie in words low to high of its shard."""
    start, end = F.greatest(low, F.col("start")) - F.col("start"), F.least(high, F.col("end")) - F.col("start")
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


#: Names that the plan gives columns of its own; columns of documents so named are set aside meanwhile.
OWN_NAMES = frozenset("size source_size target copies spans taken run bucket shard shards shard_size quota start end blocks first over block of_text seats".split())


def apply(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The mixed documents with the columns of ``docs``: whole copies, and excerpts of those at the edge of a taken run of blocks."""
    aside = {c: f"__aside_{i}" if c.lower() in OWN_NAMES else c for i, c in enumerate(docs.columns)}
    mixed = plan(docs.withColumnsRenamed(aside), weights, keep=list(aside.values()))
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    rows = mixed.withColumn("run", F.explode(F.concat(F.array_repeat(whole, F.col("copies").cast("int")), F.col("spans"))))
    length = F.col("run.end") - F.col("run.start")
    part = F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), (F.col("run.start") + 1).cast("int"), length.cast("int"))
    rows = rows.withColumn("text", F.when(length < F.col("size"), F.array_join(part, " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(F.col(f"`{named}`").alias(c) for c, named in aside.items()))
