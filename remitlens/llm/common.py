"""What the operators of this subpackage share: the cluster's folder, files on it, words."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers that see this folder import the package, wherever the driver was started."""
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(filter(None, [root, held.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder takes its place if all tasks run on this machine, else this fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="remitlens-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder and cut its lineage."""
    importable(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path on it; for executors and driver."""
    if uri.startswith("file:"):
        uri = re.sub(r"^file:/+", "file:///", uri)
    elif "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: bytes) -> bytes:
    """Lower-case A-Z only."""
    return text.lower()


def words(text: str | None) -> list[bytes]:
    """Words of the text in UTF-8, A-Z lower-cased; ``bytes.split`` splits at exactly ASCII white space."""
    return (text or "").encode().lower().split()
