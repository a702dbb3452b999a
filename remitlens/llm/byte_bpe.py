"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (one ``base64(token) rank`` a line) becomes a tokenizers model: every
byte is written as one printable character, every pair of tokens that joins to a
token is a merge, in order of that token's rank. Words, the matches of the split
pattern, are encoded independently of each other, so each worker encodes a word
the first time it meets it and reuses the ids afterwards.

Nulls are empty texts and empty texts have no ids. Texts of any length are
encoded whole. Repeated rows give repeated results; an empty table gives none. Columns
of the names that are added, in any case, are replaced; all others are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from remitlens.llm.common import importable

#: Characters of texts that the cached path handles; a text with others, or with a string of an added token, goes
#: through the library as a whole.
CACHED_BELOW = 0x370
#: Distinct words that a worker keeps, and characters that it encodes at once.
CACHE_WORDS, CHUNK_CHARS = 1 << 19, 1 << 20


@lru_cache(1)
def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> Iterator[tuple[bytes, bytes]]:
    """Every pair of tokens whose joint bytes are a token, by that token's rank."""
    for token in sorted(ranks, key=ranks.get):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                yield token[:i], token[i:]


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers Tokenizer that gives the ids that rank-wise merging of each match gives."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    chars = byte_chars()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    model = models.BPE(
        vocab={shown[t]: r for t, r in ranks.items()},
        merges=[(shown[a], shown[b]) for a, b in merges(ranks)],
        ignore_merges=True,
    )
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    made.decoder = decoders.ByteLevel()
    return made


def _ranges(kind: str) -> str:
    """The characters under CACHED_BELOW of a Unicode category, as ranges of a character class."""
    codes = [c for c in range(CACHED_BELOW) if unicodedata.category(chr(c))[0] == kind]
    runs = ([c for _, c in g] for _, g in groupby(enumerate(codes), lambda x: x[1] - x[0]))
    return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)


def narrow_pattern(pattern: str) -> re.Pattern:
    """The split pattern for ``re``, with the classes that it names spelt out below CACHED_BELOW."""
    letters, numbers, space = _ranges("L"), _ranges("N"), r"\u0009-\u000d \u0085 "
    spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    for name, inside in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
        spelt = spelt.replace(name, inside)
    return re.compile(spelt)


class WordEncoder:
    """Texts to ids with one tokenizer; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer, pattern: str):
        self.tokenizer, self.model, self.split = tokenizer, tokenizer.model, narrow_pattern(pattern).findall
        self.shown = dict(enumerate(byte_chars()))
        named = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.wide = re.compile("|".join([f"[^\\u0000-\\u{CACHED_BELOW - 1:04x}]", *named])).search
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        """Ids of a text by the library's own splitting."""
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return struct.pack(f"<{len(found)}I", *found.ids)

    def _word(self, word: str) -> bytes:
        """Ids of one match of the pattern by the library's model alone."""
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def encode(self, texts: list[str]) -> list[bytes]:
        out, start = [], 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= CHUNK_CHARS):
                chars += len(texts[end])
                end += 1
            out += self._chunk(texts[start:end])
            start = end
        return out

    def _chunk(self, texts: list[str]) -> list[bytes]:
        parts = [() if self.wide(t) else self.split(t) for t in texts]
        words = list(chain.from_iterable(parts))
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        ids = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(map(is_, ids, repeat(None))) if x] if None in ids else []
        self.known.update((w, self._word(w)) for w in {words[i] for i in missing})
        for i in missing:
            ids[i] = self.known[words[i]]
        out, at = [], 0
        for text, part in zip(texts, parts, strict=True):
            out.append(b"".join(ids[at : at + len(part)]) if part or not text else self._whole(text))
            at += len(part)
        return out


class Decoder:
    """Ids back to bytes by the reversed byte table.

    Ids are joined as bytes, never as characters, so a character whose bytes
    are split among several ids comes back whole.
    """

    def __init__(self, shown: dict[str, int]):
        back = {c: b for b, c in enumerate(byte_chars())}
        self.table = [b""] * (max(shown.values()) + 1)
        for token, i in shown.items():
            self.table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.lengths = np.array([len(t) for t in self.table], np.int64)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def spans(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets where each id starts and ends in the encoded text."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        return np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], ends


@lru_cache(4)
def codec(ranks_path: str, pattern: str) -> tuple[WordEncoder, Decoder]:
    """One encoder and decoder for each worker and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = tokenizer_of_ranks(load_ranks(ranks_path), pattern)
    return WordEncoder(made, pattern), Decoder(made.get_vocab())


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batch of about CHUNK_CHARS characters, with their texts; null is empty."""
    texts = [x or "" for x in batch.column(column).to_pylist()]
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= CHUNK_CHARS or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, chars = i + 1, 0


def with_columns_from(df: DataFrame, added: str, make) -> DataFrame:
    """``df`` with the columns of the DDL ``added``, replacing any of those names.

    ``make`` turns a batch into slices of it, each with the added columns' Arrow arrays.
    """
    importable(df.sparkSession)
    fields = T._parse_datatype_string(added).fields
    names = [f.name for f in fields]
    taken = {n.lower() for n in names}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]

    def run(batches):
        for batch in batches:
            for piece, arrays in make(batch):
                own = [piece.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, *arrays], names=[*(f.name for f in kept), *names])

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int) and each id's ``starts`` and ``ends`` in bytes of the UTF-8 text."""

    def make(batch):
        encoder, decoder = codec(ranks_path, pattern)
        for piece, texts in pieces(batch, text):
            found = encoder.encode(texts)
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in found]
            spans = [decoder.spans(x) for x in found]
            yield piece, [
                pa.array(ids, pa.list_(pa.int32())),
                pa.array([s.astype(np.int64) for s, _ in spans], pa.list_(pa.int64())),
                pa.array([e.astype(np.int64) for _, e in spans], pa.list_(pa.int64())),
            ]

    return with_columns_from(df, "ids array<int>, starts array<bigint>, ends array<bigint>", make)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of its ids; null ids are none."""

    def make(batch):
        _, decoder = codec(ranks_path, pattern)
        for i in range(0, batch.num_rows, 64):
            piece = batch.slice(i, 64)
            lists = piece.column(ids).to_pylist()
            yield piece, [pa.array([decoder.decode(np.array(x or [], "<u4").tobytes()) for x in lists], pa.binary())]

    return with_columns_from(df, "decoded binary", make)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with the digests of its ids and of what they decode to.

    Encoding and decoding run in the same Python worker, so ids never cross to the JVM.
    """
    importable(df.sparkSession)
    added = T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string").fields
    gone = {text.lower(), *(f.name for f in added)}
    schema = T.StructType([*(f for f in df.schema.fields if f.name.lower() not in gone), *added])
    kept = schema.names[:-3]

    def run(batches):
        encoder, decoder = codec(ranks_path, pattern)
        for batch in batches:
            for piece, texts in pieces(batch, text):
                found = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(c) for c in kept),
                        pa.array([len(x) // 4 for x in found], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                        pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in found]),
                    ],
                    names=schema.names,
                )

    return df.mapInArrow(run, schema)


def encode_packed(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and ``round_trips``: they decode to the text's bytes."""

    def make(batch):
        encoder, decoder = codec(ranks_path, pattern)
        for piece, texts in pieces(batch, text):
            found = encoder.encode(texts)
            same = [decoder.decode(x) == t.encode() for x, t in zip(found, texts, strict=True)]
            yield piece, [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary()), pa.array(same, pa.bool_())]

    return with_columns_from(df, "n_tokens long, ids binary, round_trips boolean", make)
