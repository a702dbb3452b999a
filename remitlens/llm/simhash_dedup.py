"""Near-duplicates by SimHash and exact tiled comparison.

A shingle is hashed with XXH64; a fingerprint bit is set if it is set in over
half of a text's hashes, repeats counted. More than 64 bits come from mixing the
hash once more for every further 64. Two fingerprints are linked if they differ
in at most ``radius`` bits, and documents whose fingerprints are joined by links
form a group.

Only distinct fingerprints are compared. They are ordered by population count
and cut into tiles of like population; a pair of tiles is compared with numpy
exclusive-or and bit counts, unless the population counts of their rows, in
whole and by quarters, differ beyond the radius everywhere. Within a pair of tiles
the links are reduced to a spanning forest before they leave the task, so a
family of thousands of like texts costs as many rows as it has members and no
link between two groups is lost. Where ``similarity`` is given, tiles are ordered
by number of shingles instead, and pairs whose numbers alone exclude it are skipped. The
numbers bound the similarity of sets where repeats are not counted (``distinct``).

``similar_groups`` takes such links, of a wide radius, as candidates only: distinct texts of
a candidate component are linked where their sets of shingles (of 64-bit hashes) have the
similarity, intersection over union, and components are made of these links. A candidate
component of more than ``VERIFY_ROWS`` texts is compared in pairs of parts.

Null texts are empty. A text without words has fingerprint zero, linked like any
other. Rows with a null doc_id are grouped, and a group of such rows alone has a
null component_id. Repeated rows give repeated results; an empty table gives none.
``keep_one`` keeps a row of every group, also of those of null or shared doc_ids. Texts of
any length are hashed whole, and other columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.llm.common import cut, importable, text_or_empty, words
from remitlens.llm.components import components

SEED = 42
#: Shingles whose bits are unpacked at once; rows that are compared at once.
CHUNK, BLOCK = 1 << 14, 512
#: Rows of a tile at most; fewer, down to the first number, where all would make less than TILES tiles.
TILES, TILE_ROWS = 48, (1 << 13, 1 << 18)
#: Links that a task holds before it reduces them to a forest; rows of a batch that is sent to tasks.
HELD_LINKS, DEALT_ROWS = 1 << 20, 1 << 16
#: Standard deviations that random fingerprints lie beyond the radius in the lanes that are compared first.
CLEAR = 3.5
#: Texts of a candidate component that are compared exactly with as many others in a task.
VERIFY_ROWS = 1 << 10


def shingle_hashes(tokens: list[bytes], size: int, hasher) -> np.ndarray:
    """XXH64 of every run of ``size`` tokens, of the whole sequence if there are fewer."""
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(tokens))
    cuts = map(slice, starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter(map(hasher, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, len(tokens) - size + 1)


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits of each hash; lane 0 is the hash itself. The multipliers are fixed values of splitmix64."""
    if lane == 0:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The fingerprint as ``lanes`` unsigned 64-bit integers."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes):
        set_in = np.zeros(64, np.int64)
        for i in range(0, len(hashes), CHUNK):
            part = np.ascontiguousarray(mixed(hashes[i : i + CHUNK], lane)).astype("<u8", copy=False)
            set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0]
    return out


def text_key(text: str = "text") -> Column:
    """What tells texts apart."""
    return F.md5(text_or_empty(text).cast("binary"))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """``doc_id``, ``text_key``, ``fingerprint`` (16 lowercase hex digits a lane) and ``n_shingles`` of every row; ``distinct``: of shingles without their repeats."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            found, counts = [], []
            for t in batch.column(2):
                hashes = shingle_hashes(words(t.as_py()), shingle, xxh64_intdigest)
                hashes = np.unique(hashes) if distinct else hashes
                found.append("".join(f"{x:016x}" for x in simhash(hashes, lanes).tolist()))
                counts.append(len(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(found, pa.string()), pa.array(counts, pa.int64())],
                names=["doc_id", "text_key", "fingerprint", "n_shingles"],
            )

    importable(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long"), text_key(text), F.col(text))
    return rows.mapInArrow(run, "doc_id long, text_key string, fingerprint string, n_shingles long")


def _unhex(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Hex fingerprints as rows of unsigned 64-bit integers."""
    texts = column.to_pylist()
    lanes = len(texts[0]) // 16 if texts else 1
    return np.frombuffer(bytes.fromhex("".join(texts)), ">u8").astype(np.uint64).reshape(-1, lanes)


def populations(prints: np.ndarray) -> np.ndarray:
    """Set bits of each fingerprint: of the whole, then of each quarter of its bits."""
    counts = np.bitwise_count(np.ascontiguousarray(prints).astype("<u8", copy=False).view("<u2")).astype(np.int64)
    counts = counts.reshape(len(prints), 4, -1).sum(axis=2)
    return np.column_stack([counts.sum(axis=1), counts])


def _with_order(reps: DataFrame, by_size: bool) -> DataFrame:
    """The representatives with ``population`` and an ``order_key`` along which tiles are cut."""

    def run(batches):
        for batch in batches:
            prints = _unhex(batch.column("fingerprint"))
            if not len(prints):
                continue
            pops = populations(prints)
            tail = (prints[:, 0] >> np.uint64(32)).astype(np.int64)
            if by_size:
                key = (np.minimum(np.array(batch.column("least")), 2**30) << 32) | tail
            else:
                key = pops[:, 0]
                for i in range(1, 4):
                    key = key * 128 + np.minimum(pops[:, i], 127)
                key = (key << 32) | tail
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pops[:, 0], pa.int64()), pa.array(key, pa.int64())], names=[*batch.schema.names, "population", "order_key"]
            )

    schema = "fingerprint string, first_id long, least long, most long, population long, order_key long"
    return reps.select("fingerprint", "first_id", "least", "most").mapInArrow(run, schema)


class Forest:
    """Connected rows of a task, kept as each row's smallest reachable row."""

    def __init__(self, n: int):
        self.root, self.held, self.n_held = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.n_held += len(a)
            if self.n_held > HELD_LINKS:
                self.reduce()

    def reduce(self) -> None:
        if not self.held:
            return
        a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n_held, root = [], 0, self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        self.root = root

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        self.reduce()
        linked = np.flatnonzero(self.root != np.arange(len(self.root)))
        return linked, self.root[linked]


def _apart(low: np.ndarray, high: np.ndarray, i: int, radius: int) -> np.ndarray:
    """Of which blocks all rows differ from those of block i by population counts alone."""
    gap = np.maximum(np.maximum(low - high[i], low[i] - high), 0)
    return (gap[:, 0] > radius) | (gap[:, 1:].sum(axis=1) > radius)


def first_lanes(lanes: int, radius: int) -> int:
    """Lanes after which few pairs of random fingerprints are still within the radius; at least two, if there are as many."""
    clear = (n for n in range(min(lanes, 2), lanes) if 32 * n - CLEAR * (16 * n) ** 0.5 >= radius)
    return next(clear, lanes)


def compare_tiles(prints: np.ndarray, sizes: np.ndarray, tile: np.ndarray, radius: int, similarity: float, largest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two tiles, or within one if ``tile`` is constant; rows come by tile.

    Texts of a row have from ``sizes`` to ``largest`` shingles, exactly ``sizes`` if that is not given.
    """
    largest = sizes if largest is None else largest
    forest, lanes = Forest(len(prints)), prints.shape[1]
    pops = populations(prints)
    border = int(np.searchsorted(tile, tile[-1]))  # rows before it are of the first tile; 0: there is one tile
    starts = np.concatenate([np.arange(0, border, BLOCK), np.arange(border, len(tile), BLOCK)])
    ends = np.append(starts[1:], len(tile))
    low = np.array([pops[a:b].min(axis=0) for a, b in zip(starts, ends, strict=True)])
    high = np.array([pops[a:b].max(axis=0) for a, b in zip(starts, ends, strict=True)])
    least = np.array([sizes[a:b].min() for a, b in zip(starts, ends, strict=True)])
    most = np.array([largest[a:b].max() for a, b in zip(starts, ends, strict=True)])
    columns = [np.ascontiguousarray(prints[:, k]) for k in range(lanes)]
    whole = first_lanes(lanes, radius)
    for i in range(len(starts)):
        skip = _apart(low, high, i, radius) | (most < similarity * least[i]) | (most[i] < similarity * least)
        skip[:i] = True
        if starts[i] < border:
            skip[starts < border] = True
        elif border:
            break
        for j in np.flatnonzero(~skip):
            rows, cols = slice(starts[i], ends[i]), slice(starts[j], ends[j])
            differ = np.bitwise_count(columns[0][rows, None] ^ columns[0][None, cols])
            differ = differ.astype(np.uint16) if whole > 3 else differ
            for k in range(1, whole):
                differ += np.bitwise_count(columns[k][rows, None] ^ columns[k][None, cols])
            a, b = np.nonzero(differ <= radius)
            a, b = a + starts[i], b + starts[j]
            keep = a < b
            a, b = a[keep], b[keep]
            if whole < lanes and len(a):
                keep = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64) <= radius
                a, b = a[keep], b[keep]
            if similarity and len(a):
                keep = (largest[a] >= similarity * sizes[b]) & (largest[b] >= similarity * sizes[a])
                a, b = a[keep], b[keep]
            forest.add(a, b)
    return forest.edges()


def _spans(ordered: DataFrame, bounds: np.ndarray, by_size: bool) -> np.ndarray:
    """Least and greatest value of what orders the rows of every tile, a row for each tile: population, or numbers of shingles."""
    columns = ("least", "most") if by_size else ("population", "population")

    def run(batches):
        for batch in batches:
            tile = np.searchsorted(bounds, np.asarray(batch.column("order_key")), "right")
            at, of = np.unique(tile, return_inverse=True)
            low, high = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), -1)
            np.minimum.at(low, of, np.asarray(batch.column(columns[0])))
            np.maximum.at(high, of, np.asarray(batch.column(columns[1])))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, low, high)], names=["tile", "low", "high"])

    out = np.column_stack([np.full(len(bounds) + 1, np.iinfo(np.int64).max), np.full(len(bounds) + 1, -1)])
    rows = ordered.select("order_key", *dict.fromkeys(columns)).mapInArrow(run, "tile long, low long, high long")
    for r in rows.groupBy("tile").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        out[r["tile"]] = r["low"], r["high"]
    return out


def _partners(spans: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last tile that each tile is compared with; tiles are in ascending order of what their spans are of.

    All tiles between are compared too, which loses no pair that the spans allow.
    """
    n = len(spans)
    reach = spans[:, 1] / similarity if similarity else spans[:, 1] + radius
    least = np.minimum.accumulate(spans[::-1, 0])[::-1]
    last = np.maximum(np.maximum.accumulate(np.searchsorted(least, reach, "right") - 1), np.arange(n))
    return np.searchsorted(last, np.arange(n)), last


def links(reps: DataFrame, radius: int, similarity: float = 0.0) -> DataFrame:
    """``(fingerprint, first_id, least, most)``, the latter of shingles, to edges ``(a, b)`` that connect exactly what links of ``radius`` connect."""
    ordered = cut(_with_order(reps, by_size=similarity > 0))
    n = ordered.count()
    rows = min(max(n // TILES, TILE_ROWS[0]), TILE_ROWS[1])
    tiles = max(1, -(-n // rows))
    cuts = [i / tiles for i in range(1, tiles)]
    bounds = (ordered.agg(F.percentile_approx("order_key", cuts, 20 * tiles + 10000)).first()[0] if cuts else None) or []
    bounds = np.array(sorted(set(bounds)), np.int64)
    low, high = _partners(_spans(ordered, bounds, similarity > 0), radius, similarity)

    def deal(batches):
        for batch in batches:
            tile = np.searchsorted(bounds, np.asarray(batch.column("order_key")), "right")
            times = high[tile] - low[tile] + 1
            rows = np.repeat(np.arange(len(tile)), times)
            other = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times - low[tile], times)
            own = tile[rows]
            for some in (slice(i, i + DEALT_ROWS) for i in range(0, len(rows), DEALT_ROWS)):
                made = [pa.array(x, pa.int32()) for x in (np.minimum(own[some], other[some]), np.maximum(own[some], other[some]), own[some])]
                yield pa.RecordBatch.from_arrays([*made, *batch.take(pa.array(rows[some])).columns], names=["first", "second", "tile", *batch.schema.names])

    kind = "first int, second int, tile int, fingerprint string, least long, most long, order_key long"
    dealt = ordered.select("fingerprint", "least", "most", "order_key").mapInArrow(deal, kind)

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("tile", "ascending"), ("order_key", "ascending"), ("fingerprint", "ascending")])
        a, b = compare_tiles(_unhex(group["fingerprint"]), np.array(group["least"]), np.array(group["tile"]), radius, similarity, np.array(group["most"]))
        return pa.table({"a": group["fingerprint"].take(pa.array(a)).cast(pa.string()), "b": group["fingerprint"].take(pa.array(b)).cast(pa.string())})

    return dealt.groupBy("first", "second").applyInArrow(compare, "a string, b string")


def _representatives(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints, with the least and greatest number of shingles of the texts that have them."""
    return cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most")))


def groups(prints: DataFrame, radius: int, similarity: float = 0.0) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id``: the smallest doc_id that links of ``radius`` reach, itself included.

    Also ``component``, which is never null, and ``text_key`` if the prints have it.
    """
    prints = cut(prints)
    reps = _representatives(prints)
    return _named(prints, reps, components(links(reps, radius, similarity)), "fingerprint")


def _named(prints: DataFrame, reps: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """The documents with the smallest doc_id of their component of ``labels`` of nodes; ``reps`` has every node's ``first_id``."""
    labels = labels.select(F.col("node").alias(node), "component")
    named = cut(reps.join(labels, node, "left").withColumn("component", F.coalesce("component", node)))
    least = cut(named.groupBy("component").agg(F.min("first_id").alias("component_id")))  # else a large component's rows meet in one task of the join
    named = named.join(least, "component").select(node, "component", "component_id")
    keys = [c for c in ("text_key",) if c in prints.columns]
    return prints.join(named, node).select("doc_id", "fingerprint", "component_id", "component", *keys)


def similar_pairs(sets: list[np.ndarray], part: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of sets of the similarity connect: between two parts, or within one if ``part`` is constant."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    root, held, both = np.arange(len(sets)), np.zeros(ids.max() + 1, bool), bool((part != part[0]).any())
    found = []
    for a in range(len(sets) - 1):
        others = root[a + 1 :] != root[a]
        others &= np.minimum(sizes[a + 1 :], sizes[a]) >= similarity * np.maximum(sizes[a + 1 :], sizes[a])
        if both:
            others &= part[a + 1 :] != part[a]
        others = np.flatnonzero(others) + a + 1
        if not len(others):
            continue
        own = ids[starts[a] : starts[a] + sizes[a]]
        held[own] = True
        ends = np.cumsum(sizes[others])
        at = np.arange(ends[-1]) + np.repeat(starts[others] - ends + sizes[others], sizes[others])
        common = np.add.reduceat(held[ids[at]], ends - sizes[others], dtype=np.int64)
        held[own] = False
        for b in others[common / (sizes[a] + sizes[others] - common) >= similarity].tolist():
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
                found.append((a, b))
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return a, b


def _shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` with ``shingles`` in place of their text: the distinct hashes as bytes, a single zero for a text without words."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            at = batch.schema.names.index("text")
            sets = (np.unique(shingle_hashes(words(t.as_py()), shingle, xxh64_intdigest)) for t in batch.column(at))
            found = pa.array([(s if len(s) else np.zeros(1, np.uint64)).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), found], names=[*(n for n in batch.schema.names if n != "text"), "shingles"])

    kept = [f for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", shingles binary")


def _first_rows(df: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``df`` for each of ``chosen`` (``doc_id``, ``text_key``, others), whose other columns it gets."""
    own = lambda i, key: F.concat_ws(":", key, i.cast("long").cast("string"))
    more = [F.col(c).alias(f"__{c}") for c in chosen.columns if c != "doc_id"]
    chosen = chosen.select(own(F.col("doc_id"), F.col("text_key")).alias("__row"), *more)
    first = Window.partitionBy("__row").orderBy(*(F.col(f"`{c}`") for c, kind in df.dtypes if kind not in ("map", "variant")))
    rows = df.withColumn("__row", own(F.col(f"`{doc_id}`"), text_key(text))).join(chosen, "__row")
    return rows.withColumn("__nth", F.row_number().over(first)).where("__nth = 1")


def similar_groups(prints: DataFrame, df: DataFrame, radius: int, similarity: float, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``groups``, of links between texts of ``df`` whose sets of shingles have the similarity; ``radius`` finds candidates for them alone."""
    prints = cut(prints)
    reps = _representatives(prints)
    labels = components(links(reps, radius, similarity)).select(F.col("node").alias("fingerprint"), "component")
    texts = cut(prints.groupBy("text_key").agg(F.min("fingerprint").alias("fingerprint"), F.min("doc_id").alias("first_id")))
    texts_of = texts.join(labels, "fingerprint", "left").withColumn("candidate", F.coalesce("component", "fingerprint"))
    members = cut(texts_of.groupBy("candidate").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / VERIFY_ROWS).cast("int")
    chosen = texts_of.join(members, "candidate").select(F.col("first_id").alias("doc_id"), "text_key", "candidate", parts.alias("parts"))
    rows = _first_rows(df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").alias("text")), cut(chosen), doc_id, "text")
    sets = _shingle_sets(rows.select(F.col("__text_key").alias("text_key"), F.col("__candidate").alias("candidate"), F.col("__parts").alias("parts"), "text"), shingle)
    sets = sets.withColumn("part", F.pmod(F.xxhash64("text_key"), F.col("parts")).cast("int"))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sets = sets.select("candidate", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "text_key", "shingles")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("text_key")
        a, b = similar_pairs([np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()], np.array(group["part"]), similarity)
        return pa.table({n: group["text_key"].take(pa.array(x)).cast(pa.string()) for n, x in (("a", a), ("b", b))})

    verified = components(sets.groupBy("candidate", "low", "high").applyInArrow(compare, "a string, b string"))
    return _named(prints, texts, verified, "text_key")


def keep_one(df: DataFrame, grouped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each group: of its smallest doc_id, null only where no row has one.

    Rows are told apart by doc_id and text, so a group keeps its row whatever ids are null or shared.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    chosen = grouped.groupBy("component").agg(first).select("first.doc_id", "first.text_key")
    return _first_rows(df, chosen, doc_id, text).select(*(F.col(f"`{c}`") for c in df.columns))
