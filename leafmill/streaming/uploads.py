"""Uploaded packages as a stream: each file is gated, told apart by its bytes, read once, and added to two tables.

``uploads`` has a row a file (batch_id, path, name, length, sha256, status, error): ``accepted``, ``duplicate`` (its bytes were
accepted before, or in the same batch under a smaller path) or ``rejected`` by the gate. ``objects`` has the objects of
the accepted ones, as ``sources.packages.objects`` gives them, bad parts as rows with an error.

A batch writes the folders of its own number and nothing else, and looks for earlier bytes in the folders of smaller
numbers only. So a batch that is run again after a failure, or a lost executor, replaces what it wrote, and a restarted
stream goes on where its checkpoint says. Earlier hashes are joined, not collected; a file that the gate rejects by its size
is never opened.

Defined results: an empty file is rejected by none but its name, and gives one error row, as any file that is no archive; a
file whose name has another ending is rejected whatever is in it; an empty folder gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import validate
from ..sources import packages

LIMIT = 50 * 1024 * 1024
#: Of how many tasks, at most, a job is that looks at the files of a batch: without it each file is a task.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
FILES = "path string, modificationTime timestamp, length bigint, content binary"
LOG = "path string, name string, length bigint, sha256 string, status string, error string, batch_id bigint"


def arriving(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """The stream of files below a path, at most ``per_batch`` a batch."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)


def judged(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """path, name, length, sha256, error; bytes are hashed of files that pass the gate only."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    gated = validate.gate_uploads(named, "name", F.col("length"), limit)
    # Two reads of the files' list, so that the second never opens a file that is too large.
    passed = gated.where((F.col("length") <= limit) & F.col("success")).select("path", "name", "length", F.sha2("content", 256).alias("sha256"), "error")
    rejected = gated.where(~F.col("success")).select("path", "name", "length", F.lit(None).cast("string").alias("sha256"), "error")
    return passed.unionByName(rejected)


def told(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """Adds status: of equal bytes the smallest path is accepted, unless ``earlier`` (sha256) has them."""
    first = rows.where("sha256 is not null").groupBy("sha256").agg(F.min("path").alias("first"))
    new = first.join(earlier.select("sha256"), "sha256", "left_anti").select(F.col("first").alias("path"), F.lit(True).alias("new"))
    status = F.when(F.col("error").isNotNull(), "rejected").when(F.col("new"), "accepted").otherwise("duplicate")
    return rows.join(new, "path", "left").withColumn("status", status).drop("new")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def log(spark: SparkSession, tables: str) -> DataFrame:
    return _read(spark, f"{tables}/uploads", LOG)


def objects(spark: SparkSession, tables: str) -> DataFrame:
    return _read(spark, f"{tables}/objects", packages.OBJECTS + ", batch_id bigint")


def add(files: DataFrame, batch: int, tables: str, limit: int = LIMIT) -> None:
    """One batch of files (path, length, content) into the tables below ``tables``; the same again if it is run again."""
    spark = files.sparkSession
    # Spark deals out small files by a few, for what opening one may cost; so many tasks cost more than the files.
    files = files.coalesce(4 * spark.sparkContext.defaultParallelism)
    earlier = log(spark, tables).where((F.col("batch_id") < batch) & (F.col("status") == "accepted"))
    told(judged(files, limit), earlier).select("path", "name", "length", "sha256", "status", "error").write.mode("overwrite").parquet(f"{tables}/uploads/batch_id={batch}")
    accepted = spark.read.parquet(f"{tables}/uploads/batch_id={batch}").where("status = 'accepted'").select("path")
    held = files.where((F.col("length") <= limit)).join(accepted, "path", "left_semi").select(F.col("path").alias("package"), "content")
    packages.objects(packages.parts(held), broken=True).write.mode("overwrite").parquet(f"{tables}/objects/batch_id={batch}")


def ingest(spark: SparkSession, path: str, tables: str, checkpoint: str, limit: int = LIMIT, per_batch: int = 1000, interval: str | None = None) -> StreamingQuery:
    """The started stream from a folder to the tables; without an ``interval`` it ends when all that is there is read. It
    runs in a session of its own, with the settings that this one has now."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    out = arriving(_own(spark), path, per_batch).writeStream.foreachBatch(lambda files, batch: add(files, batch, tables, limit))
    return out.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _own(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one, but for the tasks of a listing."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set(LISTING, str(min(int(spark.conf.get(LISTING)), 4 * spark.sparkContext.defaultParallelism)))
    return own
