"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of its own and of the lines
before and after it. The marginal probabilities of *good* that forward-backward
gives, weighted by line length, make the document's share of good text, and a
logistic curve fitted to labelled documents turns that share into a score.

The field is fitted on at most ``SAMPLE_DOCS`` labelled documents, those with the
least hash of their doc_id, and at most ``SAMPLE_LINES`` consecutive lines of each, so
a labelled document of any length counts. Lines take their document's label. They form
chains of their document, and once more chains in which lines of one document are
followed by lines of another, as if they were one text; so the field sees labels change
from line to line, and can tell the good lines of a document from its bad ones. Scoring
covers every line of every document.

Null texts are empty, and an empty text is one empty line, which is scored like
any other. Without labels of both kinds every score is the share of good labels,
or 0.5 without any. A doc_id that is labelled repeatedly counts as good only if
all its labels are; rows and labels without a doc_id teach nothing. Repeated documents
get equal scores; an empty table gives none. Texts of any length are scored whole. A
column of the score's name, in any case, is replaced; all others are kept.
"""

from __future__ import annotations

from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.byte_bpe import pieces, with_columns_from
from remitlens.llm.common import importable

#: Bound of the labelled sample: documents, and lines of each, so half a million lines in all; lines of a training chain of one document.
SAMPLE_DOCS, SAMPLE_LINES, CHAIN_LINES = 4000, 128, 32
#: Training: steps, step size, ridge penalty of the weights.
STEPS, RATE, RIDGE = 200, 0.08, 1e-3

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "bar": b"|",
    "bang": b"!",
    "symbol": b"#$%&*+/<=>@\\^_~`{}[]",
    "stop": b".,;:?'\"()-",
    "space": b" \t\r\x0b\x0c",
    "lead": bytes(range(0xC0, 0x100)),
    "inner": bytes(range(0x80, 0xC0)),
}
#: Own features, in order; those that the neighbouring lines show as well come first.
_SHARED = ("upper", "bar", "bang", "symbol", "digit", "repeats")
_OWN = (*_SHARED, "stop", "space", "lead", "distinct", "word_length", "log_length", "again")


def own_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features that all lines of all texts have of their own, lengths of the lines in code points, and lines of each text."""
    lines_of = np.array([t.count("\n") + 1 for t in texts], np.int64)
    joined = "\n".join(texts)
    raw = np.frombuffer(joined.encode() + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = {}
    for kind, members in _KINDS.items():
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        counts[kind] = total[ends] - total[starts]
    length = ends - starts - counts["inner"]
    size = np.maximum(length, 1)
    lines = joined.split("\n")
    split = [x.split() for x in lines]
    n_words = np.array([len(w) for w in split], float)
    repeats = np.array([sum(map(eq, w, w[1:])) for w in split], float)
    distinct = np.array([len(set(w)) for w in split], float)
    again, at = np.zeros(len(lines)), 0
    for n in lines_of.tolist():
        seen = set()
        for k in range(at, at + n):
            again[k] = lines[k] in seen and bool(lines[k])
            seen.add(lines[k])
        at += n
    value = {k: counts[k] / size for k in ("upper", "bar", "bang", "symbol", "digit", "stop", "space", "lead")}
    value |= {
        "repeats": repeats / np.maximum(n_words - 1, 1),
        "distinct": distinct / np.maximum(n_words, 1),
        "word_length": np.minimum(length / np.maximum(n_words, 1), 30) / 10,
        "log_length": np.log1p(length) / 5,
        "again": again,
    }
    return np.column_stack([value[k] for k in _OWN]).astype(np.float32), length, lines_of


def with_neighbours(own: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """All features of the lines of chains: their own, those that the lines before and after show, and whether they are first or last."""
    first = np.zeros(len(own), bool)
    first[np.concatenate([[0], np.cumsum(lines_of)[:-1]])] = True
    last = np.append(first[1:], True)
    shared = own[:, : len(_SHARED)]
    before = np.where(first[:, None], 0, np.concatenate([shared[:1], shared[:-1]]))
    after = np.where(last[:, None], 0, np.concatenate([shared[1:], shared[-1:]]))
    return np.column_stack([np.ones(len(own)), own, before, after, first, last]).astype(np.float32)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, lengths of the lines in code points, and lines of each text."""
    own, length, lines_of = own_features(texts)
    return with_neighbours(own, lines_of), length, lines_of


def chains(owns: list[np.ndarray], good: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, lines of each chain and labels of lines of the training chains of documents, given by their lines' own features.

    Pieces of several lines stand alone and, in pairs, in a chain with the next document's piece.
    """
    pieces_of = [(own[i : i + CHAIN_LINES], g) for own, g in zip(owns, good, strict=True) for i in range(0, len(own), CHAIN_LINES)]
    made = [[piece] for piece in pieces_of]
    long = [piece for piece in pieces_of if len(piece[0]) > 1]
    half = len(long) // 2
    made += [[x, y] if i % 2 else [y, x] for i, (x, y) in enumerate(zip(long[:half], long[half:], strict=False))]
    lines_of = np.array([sum(len(x) for x, _ in parts) for parts in made], np.int64)
    label = np.concatenate([np.full(len(x), g) for parts in made for x, g in parts])
    return with_neighbours(np.concatenate([x for parts in made for x, _ in parts]), lines_of), lines_of, label


def marginals(scores: np.ndarray, lines_of: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains of ``lines_of`` lines.

    scores: log potentials of the labels of each line; step: of pairs of labels.
    Returns the labels' marginals at each line, the sum over lines of the pairs'
    marginals, and the log of each chain's sum over labellings.
    """
    order = np.argsort(-lines_of, kind="stable")
    at = np.concatenate([[0], np.cumsum(lines_of)])[:-1][order]
    left = lines_of[order]
    top = scores.max(axis=1)
    own, move = np.exp(scores - top[:, None]), np.exp(step)
    alpha, scale = np.empty_like(own), np.empty(len(own))
    active = [int(np.searchsorted(-left, -t, side="left")) for t in range(int(left[0]) if len(left) else 0)]
    for t, n in enumerate(active):
        rows = at[:n] + t
        now = own[rows] * (alpha[rows - 1] @ move) if t else own[rows]
        scale[rows] = now.sum(axis=1)
        alpha[rows] = now / scale[rows][:, None]
    beta = np.ones_like(own)
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        rows = at[: active[t]] + t
        ahead = own[rows] * beta[rows] / scale[rows][:, None]
        beta[rows - 1] = ahead @ move.T
        pairs += move * (alpha[rows - 1].T @ ahead)
    log_sum = np.log(scale) + top
    starts = np.concatenate([[0], np.cumsum(lines_of)])[:-1]
    return alpha * beta, pairs, np.add.reduceat(log_sum, starts) if len(starts) else np.empty(0)


def fit_field(features: np.ndarray, lines_of: np.ndarray, label: np.ndarray) -> dict:
    """Weights of the field by gradient ascent on the conditional likelihood (Adam); ``label`` has each line's."""
    mean, spread = features.mean(axis=0), features.std(axis=0)
    mean[0], spread[0] = 0, 1
    spread[spread < 1e-6] = 1
    x = ((features - mean) / spread).astype(float)
    seen = np.eye(2)[label]
    inner = np.ones(len(label), bool)
    inner[np.cumsum(lines_of) - 1] = False  # the last line of a chain has no next
    inner = np.flatnonzero(inner)
    seen_pairs = np.bincount(2 * label[inner] + label[inner + 1], minlength=4).reshape(2, 2)
    values = [np.zeros((x.shape[1], 2)), np.zeros((2, 2))]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for i in range(1, STEPS + 1):
        marginal, pairs, _ = marginals(x @ values[0], lines_of, values[1])
        slopes = [x.T @ (seen - marginal) / len(x) - RIDGE * values[0], (seen_pairs - pairs) / len(x) - RIDGE * values[1]]
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            values[k] += RATE * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)
    return {"mean": mean, "spread": spread, "weights": values[0], "step": values[1]}


def line_marginals(model: dict, features: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Probability that each line is good, given all lines of its document."""
    x = (features - model["mean"]) / model["spread"]
    return marginals(x @ model["weights"], lines_of, model["step"])[0][:, 1]


def good_share(model: dict, features: np.ndarray, length: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Each document's share of good text: its lines' marginals weighted by length."""
    starts = np.concatenate([[0], np.cumsum(lines_of)])[:-1]
    weight = length + 1.0
    return np.add.reduceat(weight * line_marginals(model, features, lines_of), starts) / np.add.reduceat(weight, starts)


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def fit_curve(share: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from a share of good text to a probability; Newton's method with a small ridge."""
    x = np.column_stack([_logit(share), np.ones(len(share))])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (good - p) - 1e-2 * (at - [1, 0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        at = at + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1)."""
    importable(docs.sparkSession)
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("good")).join(docs.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    sample = marked.orderBy(order, "doc_id").limit(SAMPLE_DOCS)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def make(batch):
        for piece, texts in pieces(batch, "text"):
            own, length, lines_of = own_features(texts)
            parts = []
            for t, b, n in zip(texts, np.cumsum(lines_of).tolist(), lines_of.tolist(), strict=True):
                start = b - n + crc32(t.encode()) % max(1, n - SAMPLE_LINES + 1)
                parts.append(slice(start, min(b, start + SAMPLE_LINES)))
            yield piece, [pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (own, length.astype(np.int64))]

    rows = with_columns_from(found, "features binary, lengths binary", make).select("doc_id", "good", "features", "lengths")
    rows = rows.orderBy(order, "doc_id", F.xxhash64("features"), "features").limit(SAMPLE_DOCS).collect()
    good = [r["good"] for r in rows]
    if len(set(good)) < 2:
        return {"constant": float(np.mean(good)) if good else 0.5}
    lengths = [np.frombuffer(r["lengths"], np.int64) for r in rows]
    owns = [np.frombuffer(r["features"], np.float32).reshape(len(x), -1) for r, x in zip(rows, lengths, strict=True)]
    model = fit_field(*chains(owns, good))
    lines_of = np.array([len(x) for x in lengths])
    whole = with_neighbours(np.concatenate(owns), lines_of)
    model["curve"] = fit_curve(good_share(model, whole, np.concatenate(lengths), lines_of), np.array(good))
    return model


def scores_of(model: dict, texts: list[str]) -> np.ndarray:
    """Probability that each text is good."""
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    slope, offset = model["curve"]
    share = good_share(model, *line_features(texts))
    return 1 / (1 + np.exp(-np.clip(slope * _logit(share) + offset, -30, 30)))


def score(df: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the score of every row's whole text."""

    def make(batch):
        for piece, texts in pieces(batch, text):
            yield piece, [pa.array(scores_of(model, texts), pa.float64())]

    return with_columns_from(df, f"`{name}` double", make)


def held_out(doc_id: str = "doc_id"):
    """Rows that labels are not learnt from: crc32 of the doc_id as text leaves 1 modulo 3; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1
