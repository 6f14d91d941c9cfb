"""Helpers shared by the training-data operators: scratch tables, size-checked broadcasts, row keys.

Scratch tables live in the folder named by ``spark.checkpoint.dir`` (shared by driver and executors); only
where that is unset, as in tests, a temporary folder is made and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters: U+0020 and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: A broadcast side may hold at most this many bytes (rows times a fixed row width).
BROADCAST_BYTES = 32 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder; set to a new temporary folder only if the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. It is deleted when the driver's Python ends, if not before."""
    path = f"{shared_dir(spark).rstrip('/')}/leafmill-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def made_so_far() -> int:
    """A mark for ``sweep``."""
    return len(_made)


def sweep(since: int, keep: DataFrame) -> None:
    """Deletes what was made since a mark, but for the table ``keep``: for steps whose results are written in it."""
    kept = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()}  # the tables' own names, which are unique
    for k in reversed(range(since, len(_made))):
        spark, path = _made[k]
        if kept and path.rsplit("/", 1)[-1] not in kept:
            delete_path(spark, path)
            del _made[k]


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; its own cleaner has the folder then
            return


class Scratch:
    """Tables written once and read back: the lineage above them is cut and no executor's loss can undo them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes the files of a table made here, once nothing reads them any more."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(self.spark, path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, rows: int | None = None) -> DataFrame:
    """Broadcast hint only where the counted rows prove the size; otherwise the join shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= limit else df.hint("merge")


def null_safe(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    """Equality of the named columns (left to right) that holds for two nulls also."""
    out = F.lit(True)
    for a, b in names.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key() -> list[Column]:
    """Two columns that tell rows apart: equal only for rows of equal id and equal text."""
    return [F.col("doc_id").alias("__id"), F.xxhash64(F.col("text")).alias("__th")]
