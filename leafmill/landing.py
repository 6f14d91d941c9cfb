"""Intermediate results that several later steps read: written once, to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


#: A join's small side may be broadcast up to so many bytes; rows of a key beyond ``HOT`` are spread over several.
BROADCAST_BYTES, HOT = 32 << 20, 50_000


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Only where no folder is set, as in tests, a temporary one is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="leafmill-"))
        at = spark.sparkContext.getCheckpointDir()
    path = f"{at.rstrip('/')}/leafmill-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def land(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from Parquet in the shared folder: the joins above run once, and a lost executor undoes nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The same rows over as many tasks as the session shuffles to. Documents are small for what parsing them costs: the few
    tasks that their bytes alone would get are too few, and all levels made of them inherit their number."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def walk(first: DataFrame, below: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """All levels of a hierarchy, as many as there are. ``first`` has the rows of the top level, each with its ``kids`` (an
    array that may be empty), and ``below`` makes the next level's rows of those that have some. A level is written once;
    the next reads no more of it than the rows with kids. The result has no ``kids``."""
    spark, base, paths, level = first.sparkSession, fresh(first.sparkSession, name), [], first
    schema = first.withColumn("more", F.size("kids") > 0).schema
    while True:
        paths.append(f"{base}/{len(paths):04d}")
        level.withColumn("more", F.size("kids") > 0).write.parquet(paths[-1])
        left = spark.read.schema(schema).parquet(paths[-1]).where("more")
        if left.select("more").isEmpty():
            return spark.read.schema(schema).parquet(*paths).drop("kids", "more")
        level = below(left.drop("more"))


def paired(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Two tables that both grow, joined by shuffling both. Left to itself Spark goes by the bytes of files, and landed labels
    and repeated values take so few that it broadcasts millions of rows, which the driver has to hold."""
    return left.join(right.hint("merge"), on, how)


def meet(rows: DataFrame, small: DataFrame, on: list[str], key: str, spread: str, how: str = "inner", width: str | None = None) -> DataFrame:
    """``rows`` joined to ``small``, a landed table that many rows may meet with one ``key`` (one of ``on``). It is broadcast if
    its counted bytes (its rows, and the text in column ``width``) allow that; else rows of a hot key are spread by a hash
    of the column ``spread`` over several copies of that key's small rows."""
    text = F.sum(F.coalesce(F.length(width), F.lit(0))) if width else F.lit(0)
    n, held = small.agg(F.count(F.lit(1)), text).first()
    if n * 400 + (held or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), on, how)
    hot = rows.groupBy(key).count().where(F.col("count") > HOT).select(key, F.least(F.ceil(F.col("count") / HOT), F.lit(256)).cast("int").alias("__salts"))
    hot = land(hot, "hot")
    few = hot.count()
    if not few:
        return paired(rows, small, on, how)
    hot = F.broadcast(hot) if few * 200 <= BROADCAST_BYTES else hot.hint("merge")
    salts = F.coalesce("__salts", F.lit(1))
    many = small.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.hash(spread), salts)).drop("__salts")
    return paired(dealt, many, [*on, "__salt"], how).drop("__salt")


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder's own cleaner has the files then
            return
