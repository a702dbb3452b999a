"""Language-model scores of whole documents by a small gated recurrent network in numpy.

Tokens are words, A-Z lower-cased, and one end per document. The softmax over the
next token is factored by class: the most frequent words, the head, stand in classes of
like frequency, in which a second softmax chooses; every other word belongs to a
class by its last bytes, in which it has its share of the training counts, each
plus a half and a half more for all words that training never saw. The head grows
with the square root of the number of distinct words, between the bounds ``HEAD``.

Training is truncated backpropagation through windows of tokens, the state carried
from one window to the next and reset where a document starts. All training documents
are dealt by a hash of doc_id and text to rounds, and within a round to shards of about
``SHARD_TOKENS`` tokens. In a round every shard trains the network that the round before
left, and the results are averaged by their numbers of tokens, in a fixed order; so
scores do not depend on how the input is split into partitions. Small corpora are passed
over several times. Scoring carries the state through a whole document.

Counts of training words are exact and cover all training documents. The most frequent
words, at most ``COMMON`` of at most ``COMMON_BYTES`` bytes in all, go to the workers;
counts of all other words reach the documents that hold them by a join.

Null texts are empty: their one token is the end. Without training documents all
counts are zero. Repeated rows are scored alike, and each counts in training; rows
with a null doc_id count as an empty doc_id. An empty table gives no rows. Texts of any
length are scored and trained on whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm.common import ascii_lower, cut, importable

#: Words of the head, at least and at most; words of a class of the head; classes of other words; units of the state.
HEAD, HEAD_CLASS, TAIL_CLASSES, HIDDEN = (1024, 1 << 12), 64, 32, 16
COMMON, COMMON_BYTES, COUNT_BUCKETS = 1 << 17, 1 << 24, 8
#: Of eight parts of the training documents, the first part that each round takes.
ROUNDS = (0, 1, 4, 8)
#: Lanes, window and step size of each round; those of scoring.
SHAPES, RATES, SCORE_SHAPE, CLIP = ((128, 32), (128, 64), (256, 32)), (0.03, 0.02, 0.01), (256, 32), 1.0
#: Tokens of a shard; of all training at least, by passing over a small corpus at most MOST_PASSES times; shards of a round at most.
SHARD_TOKENS, LEAST_TOKENS, MOST_PASSES, MOST_SHARDS = 1 << 20, 1 << 22, 4, 1 << 14
#: Results of shards that one task averages.
FAN = 8
#: How many times longer windows of few lanes are.
LONGER = 8
#: Tokens of a lane at least, in training, so that few documents still give many steps.
LANE_TOKENS = 2048
#: Tokens that a worker gathers before it runs the network; few, and a long document among them leaves most lanes idle.
TRAIN_TOKENS, BATCH_TOKENS = 1 << 20, 1 << 21
END = ""
LN10 = math.log(10)


def split(text: str | None) -> list[bytes]:
    return ascii_lower((text or "").encode()).split()


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has; as ``split`` gives them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    number = np.bincount(np.asarray(pc.list_parent_indices(lists).filter(real)), minlength=len(column))
    return flat.filter(real), number


@lru_cache(2)
def _tail_table(classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes by the last two bytes, the second in the lower half, and by the only byte."""
    two = np.array([crc32(bytes(divmod(x, 256))) % classes for x in range(1 << 16)], np.int32)
    return two, np.array([crc32(bytes([x])) % classes for x in range(256)], np.int32)


def tail_classes(words: pa.Array) -> np.ndarray:
    """``tail_class`` of each word."""
    two, one = _tail_table(TAIL_CLASSES)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8) if len(words) else np.zeros(0, np.uint8)
    long, last = np.diff(ends) > 1, data[ends[1:] - 1].astype(np.int32)
    return np.where(long, two[(data[ends[1:] - 2].astype(np.int32) << 8 | last) * long], one[last])


def tail_class(word: bytes) -> int:
    """The class of a word that is not in the head, by its last two bytes."""
    return crc32(word[-2:]) % TAIL_CLASSES


def head_size(n_distinct: int) -> int:
    """Words of the head: the power of two about the square root of all distinct words, between the bounds."""
    return min(HEAD[1], max(HEAD[0], 1 << round(math.log2(max(n_distinct, 1)) / 2)))


class Vocabulary:
    """The common words with their counts, and what classes hold. Index 0 is the end; indexes under ``head`` are head words."""

    def __init__(self, common: list[tuple[str, int]], n_tokens: int, n_distinct: int, tail_mass: list[float]):
        self.n_tokens, self.n_distinct = n_tokens, n_distinct
        counts = dict(common)
        words = [END, *(w for w, _ in common if w != END)]
        self.head = min(head_size(n_distinct), len(words))
        self.index = {w.encode(): i for i, w in enumerate(words) if i}
        self.count = np.array([counts.get(w, 0) for w in words], float)
        self.log_count = np.log10(self.count + 0.5)
        self.groups = -(-self.head // HEAD_CLASS)
        self.classes = self.groups + TAIL_CLASSES
        self.of_word = np.array([i // HEAD_CLASS if i < self.head else self.groups + tail_class(w.encode()) for i, w in enumerate(words)], np.int32)
        self.tail_mass = np.array(tail_mass) + 0.5
        self.log_total = math.log10(n_tokens + 0.5 * (n_distinct + 1))
        self.words = pa.array(words, pa.string())
        #: Network inputs: head words, tail classes, the start.
        self.start, self.inputs = self.head + TAIL_CLASSES, self.head + TAIL_CLASSES + 1

    def symbols(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Indexes of the document's tokens and its end, -1 for words that are not common; their network symbols; the words that are not common."""
        found = np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int32, len(tokens))
        rare = [tokens[i] for i in np.flatnonzero(found < 0).tolist()]
        found = np.append(found, np.int32(0))
        symbol = np.where(found < self.head, found, self.head - self.groups + self.of_word[found])
        if rare:
            symbol[found < 0] = [self.head + tail_class(w) for w in rare]
        return found, symbol.astype(np.int32), rare


    def of_texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
        """What ``symbols`` gives, of each text."""
        words, number = words_of(column)
        found = np.asarray(pc.index_in(words, value_set=self.words).fill_null(-1)).astype(np.int32)
        symbol = np.where(found < self.head, found, self.head - self.groups + self.of_word[found])
        unknown = np.flatnonzero(found < 0)
        rare = words.take(pa.array(unknown))
        symbol[unknown] = self.head + tail_classes(rare)
        rare, ends = rare.to_pylist(), np.cumsum(number)
        cuts = np.searchsorted(unknown, ends).tolist()
        found, symbol = (np.insert(x, ends, np.int32(0)).astype(np.int32, copy=False) for x in (found, symbol))
        ends, at, cut = (ends + np.arange(1, len(ends) + 1)).tolist(), 0, 0
        for end, to in zip(ends, cuts, strict=True):
            yield found[at:end], symbol[at:end], rare[cut:to]
            at, cut = end, to


def initial(v: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters of a network that predicts single-word frequencies whatever came before."""
    rng = np.random.default_rng(5)

    def draw(*shape):
        return (rng.standard_normal(shape) * 0.1).astype(np.float32)

    mass = np.concatenate([[0.5 + v.count[g * HEAD_CLASS : min((g + 1) * HEAD_CLASS, v.head)].sum() for g in range(v.groups)], v.tail_mass])
    inside = np.full(v.groups * HEAD_CLASS, -30.0)
    inside[: v.head] = np.log(v.count[: v.head] + 0.5)
    return {
        "into": draw(3, v.inputs, HIDDEN),
        "state": draw(3, HIDDEN, HIDDEN),
        "class": draw(HIDDEN, v.classes) * 0.1,
        "class_bias": np.log(mass / mass.sum()).astype(np.float32),
        "word": (draw(v.groups, HIDDEN, HEAD_CLASS) * 0.1),
        "word_bias": inside.reshape(v.groups, HEAD_CLASS).astype(np.float32),
    }


def lanes_of(lengths: list[int], n: int) -> list[list[int]]:
    """Documents dealt into at most n lanes of about equal length, the longest first; the fullest lane comes first."""
    heap = [(0, k) for k in range(max(1, min(n, len(lengths))))]
    lanes: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        load, k = heapq.heappop(heap)
        lanes[k].append(i)
        heapq.heappush(heap, (load + lengths[i], k))
    return sorted(lanes, key=lambda x: (-sum(lengths[i] for i in x), x))


def windows(docs: list[np.ndarray], start: int, shape: tuple[int, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows (inputs, targets, fresh, place) of shape time by lane over the documents' symbols.

    fresh marks where a document starts; place numbers all tokens in the documents' order, -1 beyond a lane's end.
    A window spans the lanes that are not over, which are the first; the fewer they are, the more time it spans, up to
    LONGER times the shape's, as each step costs its overhead however few lanes take it.
    """
    lengths = [len(d) for d in docs]
    lanes = lanes_of(lengths, shape[0])
    at = np.concatenate([[0], np.cumsum(lengths)])
    loads = [sum(lengths[i] for i in lane) for lane in lanes]
    rows, first = [], np.array([start], np.int32)
    for lane in lanes:
        inputs = np.concatenate([x for i in lane for x in (first, docs[i][:-1])])
        place = np.concatenate([np.arange(at[i], at[i + 1], dtype=np.int32) for i in lane])
        rows.append((inputs.astype(np.int32, copy=False), np.concatenate([docs[i] for i in lane]), place))
    t, steps = 0, 0
    while loads and (t := t + steps) < loads[0]:
        live = sum(1 for x in loads if x > t)
        steps = min(shape[1] * min(LONGER, len(lanes) // live), loads[0] - t)
        inputs, targets, place = (np.full((steps, live), fill, np.int32) for fill in (start, 0, -1))
        for k in range(live):
            n = min(steps, loads[k] - t)
            for out, row in zip((inputs, targets, place), rows[k], strict=True):
                out[:n, k] = row[t : t + n]
        yield inputs, targets, inputs == start, place


def forward(p: dict, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray):
    """States after each step of a window, and what backpropagation needs of the steps.

    Parameters come in three: of the update gate, the reset gate and the candidate. The gathered
    inputs are overwritten step by step with the gates' and the candidate's values.
    """
    steps, live = inputs.shape
    gates, new = np.empty((steps, 2, live, HIDDEN), h.dtype), p["into"][2][inputs]
    for k in (0, 1):
        np.multiply(p["into"][k][inputs], 0.5, out=gates[:, k])  # a logistic curve is a tanh of half the argument
    states, before, inner = (np.empty((steps, live, HIDDEN), h.dtype) for _ in range(3))
    starts, to_gates, to_new = fresh.any(axis=1), p["state"][:2] * 0.5, p["state"][2]
    for t in range(steps):
        if starts[t]:
            h = h * ~fresh[t][:, None]
        before[t] = h
        gate, candidate, state = gates[t], new[t], states[t]
        gate += h @ to_gates
        np.tanh(gate, out=gate)
        gate *= 0.5
        gate += 0.5
        np.matmul(h, to_new, out=inner[t])
        candidate += gate[1] * inner[t]
        np.tanh(candidate, out=candidate)
        np.subtract(h, candidate, out=state)
        state *= gate[0]
        state += candidate
        h = state
    return states, (before, inner, gates, new)


def _exp(x: np.ndarray) -> np.ndarray:
    """Exponentials in place, of at most 80, so sums stay finite."""
    np.minimum(x, 80, out=x)
    return np.exp(x, out=x)


def output(p: dict, v: Vocabulary, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
    """Natural log probability of each target symbol; with ``grads`` also the gradient of its negative by the states."""
    tail = targets >= v.head
    group = np.where(tail, targets - v.head + v.groups, targets // HEAD_CLASS)
    here = np.arange(len(targets))
    share = states @ p["class"]
    share += p["class_bias"]
    log_p = share[here, group]
    total = _exp(share).sum(axis=1)
    log_p = log_p - np.log(total)
    back = None
    if grads is not None:
        share /= total[:, None]
        share[here, group] -= 1
        grads["class"] += states.T @ share
        grads["class_bias"] += share.sum(axis=0)
        back = share @ p["class"].T
    order = np.argsort(group.astype(np.int16), kind="stable")
    edges = np.searchsorted(group[order], np.arange(v.groups + 1))
    for g in range(v.groups):
        rows = order[edges[g] : edges[g + 1]]
        if not len(rows):
            continue
        own = states[rows]
        inside = own @ p["word"][g]
        inside += p["word_bias"][g]
        chosen, n = targets[rows] - g * HEAD_CLASS, np.arange(len(rows))
        picked = inside[n, chosen]
        total = _exp(inside).sum(axis=1)
        log_p[rows] += picked - np.log(total)
        if grads is not None:
            inside /= total[:, None]
            inside[n, chosen] -= 1
            grads["word"][g] += own.T @ inside
            grads["word_bias"][g] += inside.sum(axis=0)
            back[rows] += inside @ p["word"][g].T
    return log_p, back


def backward(p: dict, inputs: np.ndarray, fresh: np.ndarray, kept: tuple, back: np.ndarray, grads: dict) -> None:
    """Adds to ``grads`` what the states' gradient gives through the steps of one window."""
    steps = len(inputs)
    before, inner, gates, new = kept
    update, reset = gates[:, 0], gates[:, 1]
    by_new = (1 - update) * (1 - new * new)
    by_gates = np.empty_like(gates)
    np.multiply((before - new) * update, 1 - update, out=by_gates[:, 0])
    np.multiply(inner * reset * (1 - reset), by_new, out=by_gates[:, 1])
    d_new, d_inner = np.empty_like(inner), np.empty_like(inner)
    ahead, starts = np.zeros_like(before[0]), fresh.any(axis=1)
    turned = np.ascontiguousarray(p["state"].transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        d = back[t]
        d += ahead
        of_gates = by_gates[t]
        of_gates *= d
        np.multiply(d, by_new[t], out=d_new[t])
        np.multiply(d_new[t], reset[t], out=d_inner[t])
        ahead = d * update[t]
        ahead += of_gates[0] @ turned[0]
        ahead += of_gates[1] @ turned[1]
        ahead += d_inner[t] @ turned[2]
        if starts[t]:
            ahead *= ~fresh[t][:, None]
    H, flat = HIDDEN, inputs.ravel()
    held = before.reshape(-1, H).T
    order = np.argsort(flat.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    symbols = flat[order][first]
    for k, (of_state, of_input) in enumerate(((by_gates[:, 0], by_gates[:, 0]), (by_gates[:, 1], by_gates[:, 1]), (d_inner, d_new))):
        grads["state"][k] += held @ of_state.reshape(-1, H)
        grads["into"][k, symbols] += np.add.reduceat(of_input.reshape(-1, H)[order], first, axis=0)


class Trainer:
    """Adam over windows of documents' symbols."""

    def __init__(self, p: dict, v: Vocabulary, shape: tuple[int, int], rate: float):
        self.p, self.v, self.shape, self.rate = {k: x.copy() for k, x in p.items()}, v, shape, rate
        self.first, self.second = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        self.steps, self.tokens = 0, 0

    def learn(self, docs: list[np.ndarray], passes: int = 1) -> None:
        for _ in range(passes if docs else 0):
            self._pass(docs)

    def _pass(self, docs: list[np.ndarray]) -> None:
        """Steps are taken over half a full window's tokens at least; where only long documents are left, over several windows'."""
        h, n, grads = np.zeros((0, HIDDEN), np.float32), 0, {k: np.zeros_like(x) for k, x in self.p.items()}
        lanes = min(self.shape[0], max(32, sum(map(len, docs)) // LANE_TOKENS))
        for k, (inputs, targets, fresh, place) in enumerate(windows(docs, self.v.start, (lanes, self.shape[1]))):
            live = inputs.shape[1]
            h = np.zeros((live, HIDDEN), np.float32) if not k else h[:live]
            states, kept = forward(self.p, inputs, fresh, h)
            h = states[-1]
            real = place.ravel() >= 0
            back = np.zeros((real.size, HIDDEN), np.float32)
            _, back[real] = output(self.p, self.v, states.reshape(-1, HIDDEN)[real], targets.ravel()[real], grads)
            backward(self.p, inputs, fresh, kept, back.reshape(states.shape), grads)
            n += int(real.sum())
            if n >= lanes * self.shape[1] // 2:
                self._step(grads, n)
                n = 0
        if n:
            self._step(grads, n)

    def _step(self, grads: dict, n: int) -> None:
        """One step by the gradients of n tokens, which are then set to zero."""
        self.steps += 1
        self.tokens += n
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values())) / n
        scale = np.float32(1 / n * min(1.0, CLIP / (norm + 1e-12)))
        rate = np.float32(self.rate * math.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps))
        for k, g in grads.items():
            g *= scale
            self.first[k] *= np.float32(0.9)
            self.first[k] += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.001)
            self.second[k] *= np.float32(0.999)
            self.second[k] += g
            np.sqrt(self.second[k], out=g)
            g += np.float32(1e-8)
            np.divide(self.first[k], g, out=g)
            g *= rate
            self.p[k] -= g
            g.fill(0)


def log_likelihoods(p: dict, v: Vocabulary, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of the symbols of each whole document."""
    lengths = np.array([len(d) for d in docs])
    out = np.zeros(int(lengths.sum()))
    h = np.zeros((0, HIDDEN), np.float32)
    for k, (inputs, targets, fresh, place) in enumerate(windows(docs, v.start, SCORE_SHAPE)):
        live = inputs.shape[1]
        h = np.zeros((live, HIDDEN), np.float32) if not k else h[:live]
        states, _ = forward(p, inputs, fresh, h)
        h = states[-1]
        real = place.ravel() >= 0
        out[place.ravel()[real]] = output(p, v, states.reshape(-1, HIDDEN)[real], targets.ravel()[real])[0]
    return np.add.reduceat(out, np.concatenate([[0], np.cumsum(lengths)[:-1]])) if len(docs) else out


def _batched(batches, v: Vocabulary, text: str):
    """Groups of rows of about BATCH_TOKENS tokens: the batch's slice, and (indexes, symbols, rare words) of each row."""
    for batch in batches:
        start, held, size = 0, [], 0
        for i, row in enumerate(v.of_texts(batch.column(text))):
            held.append(row)
            size += len(row[0])
            if size >= BATCH_TOKENS or i == batch.num_rows - 1:
                yield batch.slice(start, i + 1 - start), held
                start, held, size = i + 1, [], 0


def count_words(train: DataFrame) -> DataFrame:
    """``word``, ``c``: how often each word stands in the training texts; the empty word is the end."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = words_of(batch.column(0))[0].value_counts()
                words = pa.concat_arrays([found.field(0), pa.array([END], pa.string())])
                yield pa.RecordBatch.from_arrays([words, pa.concat_arrays([found.field(1), pa.array([batch.num_rows], pa.int64())])], names=["word", "c"])

    return train.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The vocabulary of a table of counts.

    Words are common from the least bucket of counts on that leaves at most COMMON of them and COMMON_BYTES bytes,
    so only these and a histogram of a few hundred buckets come to the driver, and nothing is sorted.
    """
    bucket = F.floor(F.log2("c") * COUNT_BUCKETS).cast("int")
    held = counts.groupBy(bucket.alias("bucket")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.octet_length("word")).alias("size")).collect()
    n_tokens, n_distinct, left, size, least = sum(r["n"] for r in held), sum(r["v"] for r in held), COMMON, COMMON_BYTES, 1 << 20
    for r in sorted(held, key=lambda r: -r["bucket"]):
        left, size = left - r["v"], size - r["size"]
        if left < 0 or size < 0:
            break
        least = r["bucket"]
    common = counts.where(bucket >= least).toArrow().to_pylist()
    common = sorted(((r["word"], r["c"]) for r in common), key=lambda x: (-x[1], x[0]))
    last = F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % TAIL_CLASSES
    mass = counts.where(F.col("word") != END).groupBy(last.alias("k")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect()
    tail_mass = [0.0] * TAIL_CLASSES
    for r in mass:
        tail_mass[r["k"]] = r["m"]
    known = dict(common)
    for w in [w for w, _ in common if w != END][: head_size(n_distinct) - 1]:
        tail_mass[tail_class(w.encode())] -= known[w] + 0.5
    return Vocabulary(common, n_tokens, n_distinct, [max(0.0, m) for m in tail_mass])


def _average(rows: list[tuple[int, int, bytes]]) -> tuple[int, np.ndarray]:
    """Tokens and sum of (shard, tokens, sum), added in order of the shards."""
    rows = sorted(rows)
    total = np.zeros(len(rows[0][2]) // 8)
    for _, _, x in rows:
        total += np.frombuffer(x)
    return sum(n for _, n, _ in rows), total


def _partition_keys(spark: SparkSession, n: int) -> Column:
    """A constant array of n keys that a repartition by key into n deals to a partition each."""
    ids = spark.range(0, 40 * n + 200, numPartitions=1)
    held = {r["part"]: r["key"] for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("key")).collect()}
    return F.split(F.lit(",".join(str(held.get(k, -1 - k)) for k in range(n))), ",").cast("array<bigint>")


def train_round(docs: DataFrame, v: Vocabulary, p: dict[str, np.ndarray], shards: int, shape: tuple[int, int], rate: float, passes: int) -> dict[str, np.ndarray]:
    """Parameters after every shard of ``docs`` (shard, place, text) has trained ``p`` and the results are averaged."""
    names, shapes, shared = sorted(p), {k: x.shape for k, x in p.items()}, docs.sparkSession.sparkContext.broadcast((p, v))

    def run(batches):
        p, v = shared.value

        def done(own, shard):
            values = [(own.p[k].astype(float) * own.tokens).tobytes() for k in names]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((names, pa.string()), ([shard] * len(names), pa.int64()), ([own.tokens] * len(names), pa.int64()), (values, pa.binary()))], names=["name", "shard", "tokens", "total"])

        own, at, held, size = None, None, [], 0
        for batch in batches:
            for shard, (_, symbol, _) in zip(batch.column("shard").to_pylist(), v.of_texts(batch.column("text")), strict=True):
                if shard != at:
                    if own is not None:
                        own.learn(held, passes)
                        yield done(own, at)
                    own, at, held, size = Trainer(p, v, shape, rate), shard, [], 0
                held.append(symbol)
                size += len(held[-1])
                if size >= TRAIN_TOKENS:
                    own.learn(held, passes)
                    held, size = [], 0
        if own is not None:
            own.learn(held, passes)
            yield done(own, at)

    def add(group: pa.Table) -> pa.Table:
        tokens, total = _average(list(zip(*(group[c].to_pylist() for c in ("shard", "tokens", "total")), strict=True)))
        return pa.table([[group["name"][0].as_py()], [group["up"][0].as_py()], [tokens], [total.tobytes()]], schema=added)

    kind = "name string, shard long, tokens long, total binary"
    added = pa.schema([("name", pa.string()), ("shard", pa.int64()), ("tokens", pa.int64()), ("total", pa.binary())])
    dealt = docs.withColumn("key", F.element_at(_partition_keys(docs.sparkSession, shards), (F.col("shard") + 1).cast("int")))
    sums = dealt.repartition(shards, "key").sortWithinPartitions("shard", "place").select("shard", "text").mapInArrow(run, kind)
    while shards > FAN:
        shards = -(-shards // FAN)
        sums = sums.withColumn("up", F.floor(F.col("shard") / FAN)).groupBy("name", "up").applyInArrow(add, kind)
    found: dict[str, list] = {}
    for r in sums.collect():  # at most FAN sets of parameters
        found.setdefault(r["name"], []).append((r["shard"], r["tokens"], bytes(r["total"])))
    means = {k: _average(rows) for k, rows in found.items()}
    return {k: (total / n).reshape(shapes[k]).astype(np.float32) for k, (n, total) in means.items()} or p


def train(docs: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters learnt from all documents (doc_id, text)."""
    place = F.xxhash64("doc_id", "text")
    part, spread = F.pmod(place, F.lit(ROUNDS[-1])), F.shiftright(place, 8)
    p, passes = initial(v), min(MOST_PASSES, max(1, -(-LEAST_TOKENS // max(v.n_tokens, 1))))
    for (first, last), shape, rate in zip(pairwise(ROUNDS), SHAPES, RATES, strict=True):
        shards = min(MOST_SHARDS, max(1, round(v.n_tokens * (last - first) / ROUNDS[-1] / SHARD_TOKENS)))
        taken = docs.where((part >= first) & (part < last)).select(F.pmod(spread, F.lit(shards)).alias("shard"), place.alias("place"), "text")
        p = train_round(taken, v, p, shards, shape, rate, passes)
    return p


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((p, v))

    def run(batches):
        p, v = shared.value
        inside = np.log10(v.tail_mass)
        for batch, held in _batched(batches, v, "text"):
            likely = log_likelihoods(p, v, [s for _, s, _ in held]) / LN10
            n, known, base, full, rare = [], [], [], [], []
            for x, (found, symbol, words) in zip(likely.tolist(), held, strict=True):
                common = found[found >= 0]
                tail = symbol[symbol >= v.head] - v.head
                n.append(len(found))
                known.append(int((v.count[common] > 0).sum()))
                base.append(float(v.log_count[common].sum()))
                full.append(x + float(v.log_count[common[common >= v.head]].sum()) - float(inside[tail].sum()))
                rare.append([{"word": w, "n": k} for w, k in Counter(words).items()])
            kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *(pa.array(c, t) for c, t in ((n, pa.int64()), (known, pa.int64()), (base, pa.float64()), (full, pa.float64()), (rare, kind)))],
                names=["row", "doc_id", "n_tokens", "n_common", "common", "full", "rare"],
            )

    kind = "row long, doc_id long, n_tokens long, n_common long, common double, full double, rare array<struct<word string, n long>>"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(rows.mapInArrow(run, kind))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.select("row", (F.col("n") * F.log10(c + 0.5)).alias("rare"), F.when(c > 0, F.col("n")).otherwise(0).alias("rare_known"))
    rare = rare.groupBy("row").agg(F.sum("rare").alias("rare"), F.sum("rare_known").alias("rare_known"))
    made = rows.drop("rare").join(rare, "row", "left").na.fill(0, ["rare", "rare_known"])
    return made.select(
        "doc_id",
        "n_tokens",
        (F.col("n_common") + F.col("rare_known")).cast("long").alias("n_known"),
        F.lit(v.n_tokens).cast("long").alias("train_tokens"),
        (F.col("common") + F.col("rare") - F.col("n_tokens") * v.log_total).alias("base_score"),
        (F.col("full") + F.col("rare")).alias("score"),
    )


def held_out():
    """Documents that are not learnt from: crc32 of the doc_id as text leaves 1 modulo 5; null counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def score_corpus(docs: DataFrame) -> DataFrame:
    """Every document's scores; counts and network are learnt from those that are not held out."""
    importable(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    learnt = docs.where(~held_out())
    counts = cut(count_words(learnt))
    v = vocabulary(counts)
    p = train(learnt, v)
    return score(docs, counts, v, p).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
