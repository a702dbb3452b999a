"""Token ids as length-delimited binary records, with a separate offset index.

A shard file is a run of frames::

    length      8 bytes, little-endian, of the data
    checksum    4 bytes, masked CRC-32 of the length's bytes
    data        ``length`` bytes
    checksum    4 bytes, masked CRC-32 of the data

A checksum is masked, rotated right by 15 bits plus a constant, since a plain
checksum of data that holds checksums is weak. The data of a record is one
document: a byte that tells the width of an id (2 or 4 bytes), a byte that tells
whether the document has an id, the document's id (8 bytes), then its token ids.
``shard-NNNNN.idx`` holds two little-endian 64-bit integers for every frame: its
offset, and the number of ids in the shard before it. So records can be read in any
order, and a large shard is read by several tasks, each from an indexed offset on.
``_manifest.json`` lists shards and sizes.

Shards hold ascending document ids and are ordered among each other; there are as
many as the texts' bytes ask for, and rows that share a doc_id, in order of their
texts' hash, may go to several. A shard is written under a name of its attempt and
renamed, so a task that runs again after its executor was lost replaces the shard
by the same bytes.

Strings of special tokens in a text give those tokens' ids, as the library gives
them, unless ``write`` is told to take them as ordinary text. Null texts are empty and hold the end id alone; rows without an id come first;
repeated rows are repeated records; an empty table gives a manifest of no shards.
Texts of any length are one record each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import random
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm import byte_bpe
from remitlens.llm.common import file_system, importable

#: Fixed value of the mask; the rotation is by 15 bits.
MASK_DELTA = 0xA282EAD8
#: Bytes that a reader fetches at once; of a shard that one task reads.
READ_BYTES, SPLIT_BYTES = 1 << 22, 1 << 26
#: Bytes of text of a shard, up to MANY_SHARDS of them; of a shard where they would be more.
SHARD_BYTES, LARGE_BYTES, MANY_SHARDS = 1 << 25, 1 << 29, 4096
#: Least bytes of a shard, where few shards would leave cores idle.
LEAST_BYTES = 1 << 22

MANIFEST = "shard int, file string, n_records long, n_ids long, bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join([length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))])


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    """The data of a record; ids are 2 bytes wide where they all fit."""
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    return struct.pack("<BBq", wide, doc_id is not None, doc_id or 0) + ids.astype(f"<u{wide}").tobytes()


def unpack(data: bytes) -> tuple[int | None, np.ndarray]:
    wide, known, doc_id = struct.unpack_from("<BBq", data)
    return doc_id if known else None, np.frombuffer(data, f"<u{wide}", offset=10).astype("<u4")


def frames(read) -> Iterator[bytes]:
    """The data of each frame; ``read(n)`` gives the next n bytes, fewer at the end. Checks all checksums."""
    rest, at = b"", 0

    def take(n: int) -> bytes:
        nonlocal rest, at
        while len(rest) - at < n and (more := read(max(READ_BYTES, n))):
            rest, at = rest[at:] + more, 0
        at += n
        return rest[at - n : at]

    while head := take(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
            raise ValueError("a record's length is damaged")
        (n,) = struct.unpack_from("<Q", head)
        data, check = take(n), take(4)
        if len(data) < n or len(check) < 4 or masked(data) != struct.unpack("<I", check)[0]:
            raise ValueError("a record's data are damaged")
        yield data


@lru_cache(2)
def library_encoder(path: str, pattern: str, specials_as_text: bool = False) -> byte_bpe.WordEncoder:
    """The tokenizer of a tokenizers file, as the library reads it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = specials_as_text
    return byte_bpe.WordEncoder(made, pattern)


def n_shards(df: DataFrame, text: str) -> int:
    """Shards of SHARD_BYTES of text; larger ones where they would be very many, smaller ones where cores would be idle."""
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    plain = min(-(-size // SHARD_BYTES), max(MANY_SHARDS, -(-size // LARGE_BYTES)))
    return max(1, plain, min(4 * cores, size // LEAST_BYTES))


def write(
    df: DataFrame, folder: str, tokenizer: str, pattern: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, shards: int | None = None, specials_as_text: bool = False
) -> list[dict]:
    """Tokenise every text and write the records under ``folder``; returns the manifest, a row for each shard."""
    importable(df.sparkSession)
    n = shards or n_shards(df, text)
    ordered = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text").alias("of_text"), F.monotonically_increasing_id().alias("row")]  # equal rows may stand in any order
    ordered = ordered.select(*order, "text").repartitionByRange(n, "doc_id", "of_text", "row").sortWithinPartitions("doc_id", "of_text", "text").select("doc_id", "text")
    end = np.array([end_id], "<u4")

    def run(batches):
        encoder, task = library_encoder(tokenizer, pattern, specials_as_text), TaskContext.get()
        shard, out, offsets, total, size = task.partitionId(), None, [], 0, 0
        system, root = file_system(folder)
        name, mark = f"shard-{shard:05d}", f"{task.taskAttemptId()}.part"
        for batch in batches:
            for piece, texts in byte_bpe.pieces(batch, "text"):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}.rec.{mark}")
                for i, found in zip(piece.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    ids = np.concatenate([np.frombuffer(found, "<u4"), end])
                    framed = frame(pack(i, ids))
                    out.write(framed)
                    offsets.append((size, total))
                    size += len(framed)
                    total += len(ids)
        if out is not None:
            out.close()
            with system.open_output_stream(f"{root}/{name}.idx.{mark}") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            for kind in ("rec", "idx"):
                system.move(f"{root}/{name}.{kind}.{mark}", f"{root}/{name}.{kind}")
            row = {"shard": [shard], "file": [f"{name}.rec"], "n_records": [len(offsets)], "n_ids": [total], "bytes": [size]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64())]))

    manifest = sorted((r.asDict() for r in ordered.mapInArrow(run, MANIFEST).collect()), key=lambda r: r["shard"])
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/_manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_index(system, path: str, first: int, last: int) -> np.ndarray:
    """Offsets, and ids before, of the records from ``first`` to before ``last``, or to the end of the shard."""
    with system.open_input_file(path) as f:
        f.seek(16 * first)
        return np.frombuffer(f.read(16 * (last - first)), "<u8").reshape(-1, 2)


def limited(f, size: int):
    """A function that reads the next bytes of a file, no more than ``size`` in all."""

    def read(n: int) -> bytes:
        nonlocal size
        n = min(n, size)
        size -= n
        return f.read(n) if n else b""

    return read


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records, checked: ``doc_id``, ``start`` (ids of all records before), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit)."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids binary", lambda ids: pa.array([x.tobytes() for x in ids], pa.binary()))


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read``, with the CRC-32 of the ids in place of the ids, which stay in the reading worker."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: pa.array([zlib.crc32(x) for x in ids], pa.int64()))


def _read(spark: SparkSession, folder: str, schema: str, column) -> DataFrame:
    importable(spark)
    system, root = file_system(folder)
    with system.open_input_stream(f"{root}/_manifest.json") as f:
        manifest = json.loads(f.read())
    starts = np.cumsum([0, *(r["n_ids"] for r in manifest)]).tolist()
    shards = [(r["file"], r["n_records"], r["bytes"], start) for r, start in zip(manifest, starts, strict=False)]
    rows = spark.createDataFrame(shards, "file string, n_records long, bytes long, start long")
    parts = F.greatest(F.lit(1), F.least(F.ceil(F.col("bytes") / SPLIT_BYTES), F.col("n_records")))
    rows = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    n = sum(max(1, min(-(-b // SPLIT_BYTES), k)) for _, k, b, _ in shards)
    if n:
        rows = rows.repartitionByRange(n, "start", "part")

    def run(batches):
        system, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                first, last = (row["n_records"] * (row["part"] + k) // row["parts"] for k in (0, 1))
                index = read_index(system, f"{root}/{row['file'][:-4]}.idx", first, last + 1)
                start, held, size = row["start"] + int(index[0, 1]), [], 0
                with system.open_input_file(f"{root}/{row['file']}") as f:
                    f.seek(int(index[0, 0]))
                    for data in frames(limited(f, (int(index[-1, 0]) if last < row["n_records"] else row["bytes"]) - int(index[0, 0]))):
                        i, ids = unpack(data)
                        held.append((i, start, len(ids), ids))
                        start += len(ids)
                        size += len(data)
                        if size >= READ_BYTES:
                            yield made(held)
                            held, size = [], 0
                if held:
                    yield made(held)

    def made(held):
        ids, starts, counts, found = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), column(found)], names=names
        )

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def shuffled(folder: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one reader in a seeded random order, each fetched by its offset; memory holds the index alone."""
    system, root = file_system(folder)
    with system.open_input_stream(f"{root}/_manifest.json") as f:
        manifest = json.loads(f.read())
    order = [(r["file"], k) for r in manifest for k in range(r["n_records"])]
    random.Random(seed).shuffle(order)
    index, files = {}, {}
    for name, k in order:
        if name not in files:
            files[name] = system.open_input_file(f"{root}/{name}")
            index[name] = read_index(system, f"{root}/{name[:-4]}.idx", 0, files[name].size())
        at, f = int(index[name][k, 0]), files[name]
        f.seek(at)
        (length,) = struct.unpack("<Q", f.read(8))
        f.seek(at)
        yield unpack(next(frames(limited(f, length + 16))))
