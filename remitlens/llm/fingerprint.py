"""Document fingerprints by SimHash, with DataFrame functions alone.

A text's terms are its words, lower-cased, in pairs of neighbours (the last word
also alone), weighted by how often they occur. Each term's 64-bit hash votes for
the bits that it has and against the others; a fingerprint bit is set where the
votes for it are more. Votes of all 64 bits are counted in 32 sums, each of which
holds the counts of two bits in its halves.

``near`` finds all fingerprints within a Hamming radius by permuted block tables:
the bits are cut into ``radius + 3`` blocks and each table is keyed by three of
them. Fingerprints that differ in at most ``radius`` bits agree in three blocks at
least, so some table holds them under one key. Only keys that several fingerprints share
are joined, and those of a crowded key are dealt to groups, so no task compares all of them
with each other.

``with_next`` gives each document the text that follows in ascending doc_id, the
first text to the last. Documents are dealt into buckets of consecutive ids whose
bounds are quantiles, and the first of each bucket is sent to the one before, so
text is shuffled once and no task holds all documents. An id that fills several
buckets is dealt to them by the hash of its texts, in which order its rows stand.

Null texts are empty and have fingerprint zero, as have texts without words. A null
doc_id comes before all others; rows that share a doc_id follow each other by the
hash of their text. A single document follows itself. An empty table gives no rows.
Texts of any length are fingerprinted whole; repeated rows are rows of their own. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.llm.common import cut, text_or_empty

#: Rows of a bucket, and the most buckets, of each of which a row comes to the driver; beyond, buckets grow.
BUCKET_ROWS, MOST_BUCKETS = 512, 1 << 17
#: Fingerprints of a block key that a group of the join holds.
KEY_ROWS = 1024
RADIUS = 3
#: Blocks that the key of a table has.
KEY_BLOCKS = 3
_SPACE = " \t\n\x0b\f\r"
_LOW_HALVES = 0x0000000100000001
_BEFORE_ALL = -(2**63)
_ROW_BITS = 40


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _longs(values: list[int]) -> Column:
    """A constant array, which is folded into the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key, by a search in two levels."""
    width = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    full = [p for p in parts if len(p) == width]
    at = F.size(F.filter(_longs([p[-1] for p in full]), lambda x: x <= key))
    part = F.element_at(F.array(*map(_longs, [*parts, [], []])), at + 1)
    return at * width + F.size(F.filter(part, lambda x: x <= key))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, ``doc_id``, ``text``, ``next_row``, ``next_text`` of every document; rows are numbered uniquely."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_BEFORE_ALL))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), key.alias("key"))
    buckets = min(MOST_BUCKETS, -(-docs.count() // BUCKET_ROWS))
    bounds = []
    if buckets > 1:
        share = [i / buckets for i in range(1, buckets)]
        bounds = sorted(rows.agg(F.percentile_approx("key", share, 20 * buckets).alias("b")).first()["b"])
    crowded = {x: n + 1 for x, n in Counter(bounds).items() if n > 1}
    bounds = sorted({*bounds, *(x + 1 for x in crowded)})
    sizes = [1, *(crowded.get(x, 1) for x in bounds)]
    starts = list(accumulate(sizes, initial=0))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "of_key": _bucket(F.col("key"), bounds).cast("int") + 1})
    size = F.element_at(_longs(sizes), F.col("of_key"))
    place = F.least(size - 1, F.floor((F.col("hash") / 2.0**64 + 0.5) * size))  # grows with the hash
    rows = rows.withColumn("bucket", F.element_at(_longs(starts), F.col("of_key")) + place)
    first = {r["bucket"]: r["first"] for r in rows.groupBy("bucket").agg(F.min(F.struct("key", "hash")).alias("first")).collect()}
    held = sorted(first)
    before = {b: held[i - 1] for i, b in enumerate(held)}
    after = {b: held[(i + 1) % len(held)] for i, b in enumerate(held)}
    of = lambda table: F.element_at(_longs([table.get(b, -1) for b in range(starts[-1])]), (F.col("bucket") + 1).cast("int"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))
    ahead = F.struct(of(before).alias("bucket"), F.lit(1).alias("ghost"))
    is_first = (F.col("key") == of({b: x["key"] for b, x in first.items()})) & (F.col("hash") == of({b: x["hash"] for b, x in first.items()}))
    rows = rows.withColumn("to", F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", "key", "hash", "to.bucket", "to.ghost")
    order = Window.partitionBy("bucket").orderBy("ghost", "key", "hash")
    number = F.shiftleft(F.col("bucket"), _ROW_BITS) + F.row_number().over(order)
    ends = F.lead("ghost").over(order) == 1
    rows = rows.withColumns({"row": number, "next_text": F.lead("text").over(order), "ends": ends}).where("ghost = 0")
    next_row = F.when(F.col("ends"), F.shiftleft(of(after), _ROW_BITS) + 1).otherwise(F.col("row") + 1)
    return rows.select("row", "doc_id", "text", next_row.alias("next_row"), "next_text")


def terms(text: Column) -> Column:
    """The text's words in pairs of neighbours, as structs ``a`` and ``b``; the last word has no ``b``."""
    trimmed = F.btrim(F.lower(text), F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("b"))


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, which tell rows apart, and ``print``, the fingerprint of the row's text as a signed 64-bit integer."""
    found = rows.select(*keys, terms(F.col(text)).alias("terms")).select(*keys, F.explode_outer("terms").alias("term"))
    found = found.select(*keys, F.when(F.col("term.a").isNotNull(), F.xxhash64("term.a", "term.b")).alias("hash"))
    votes = [F.sum(F.shiftrightunsigned("hash", j).bitwiseAND(F.lit(_LOW_HALVES))).alias(f"v{j}") for j in range(32)]
    counted = found.groupBy(*keys).agg(F.count("hash").alias("n"), *votes)
    bits = []
    for j in range(32):
        low = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("n")
        high = F.shiftrightunsigned(f"v{j}", 32) * 2 > F.col("n")
        bits += [F.when(low, F.lit(1 << j)).otherwise(0).cast("long"), F.when(high, F.lit(_signed(1 << (j + 32)))).otherwise(0).cast("long")]
    return counted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("print"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def hexed(print_: Column) -> Column:
    return F.lpad(F.lower(F.hex(print_)), 16, "0")


def tables(radius: int) -> list[int]:
    """The masks of the block tables: every choice of KEY_BLOCKS of radius + KEY_BLOCKS blocks."""
    n = radius + KEY_BLOCKS
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(chosen)) for chosen in combinations(blocks, KEY_BLOCKS)]


def near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (``query``, ``print``, ``distance``) of distinct fingerprints of the two tables within the radius, themselves excluded.

    Both tables have a column ``print``. A pair that several tables hold is taken from the first of them alone.
    """
    masks = tables(radius)

    def keyed(df: DataFrame) -> DataFrame:
        entries = F.array(*(F.struct(F.lit(i).alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))
        return df.select("print").where("print is not null").distinct().select("print", F.explode(entries).alias("e")).select("print", "e.t", "e.k")

    same = queries is prints
    held = keyed(prints)
    shared = held.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > (1 if same else 0))
    shared = shared.select("t", "k", F.ceil(F.col("n") / KEY_ROWS).cast("int").alias("parts"))
    dealt = held.join(shared, ["t", "k"]).withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    asked = (held if same else keyed(queries)).join(shared, ["t", "k"]).withColumnRenamed("print", "query")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    differ = F.col("query").bitwiseXOR(F.col("print"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)))
    found = asked.drop("parts").join(dealt.drop("parts"), ["t", "k", "part"])
    found = found.where((F.col("query") != F.col("print")) & (F.bit_count(differ) <= radius) & (F.col("t") == first))
    return found.select("query", "print", F.bit_count(differ).alias("distance"))


def edited_likeness(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has the next document's first code points, as many or all, in
    place of the last quarter. ``n_near`` counts the other fingerprints of the table
    within the radius of the document's.
    """
    rows = with_next(docs)
    n = F.char_length("text").cast("long")
    cutting = F.floor(n / 4)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cutting).cast("int")), F.substring(F.col("next_text"), F.lit(1), cutting.cast("int")))
    rows = rows.withColumns({"n_chars": n, "edited": edited}).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("of")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("of")))
    keys = ["row", "doc_id", "next_row", "n_chars", "edited_sha256"]
    rows = rows.select(*keys, F.explode(both).alias("e")).select(*keys, "e.kind", "e.of")
    found = simhash(rows, [*keys, "kind"], "of")
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("print")))
    found = cut(found.groupBy(*keys).agg(one(0).alias("print"), one(1).alias("edited_print")))
    around = cut(near(found, found, radius).groupBy(F.col("query").alias("print")).agg(F.count("*").alias("n_near")))  # so that the join can split copies' rows
    following = found.select(F.col("row").alias("next_row"), F.col("print").alias("next_print"))
    made = found.join(following, "next_row").join(around, "print", "left")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed(F.col("print")).alias("fingerprint"),
        hexed(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )
