"""How long cached entries were fresh: an entry written again before its time to live is over stays, else it ends.

The same plan for tables and streams: sessions of a key's writes with the time to live as their gap, so state is a row a
key that is held, and is dropped when the watermark passes its end. No Python code runs in it.

Defined results: an entry of exactly the time to live is over, so a write at that moment begins anew; repeated rows
all count as writes; rows of a null key are a key of their own, rows of a null time are left out; of a stream, what ends behind the
watermark is told, and writes that are later than ``late`` allows are not seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held(writes: DataFrame, key: str, at: str, hours: float = 24, late: str = "1 hour") -> DataFrame:
    """key, since, last, until, writes: a row for each time that a key was held without a break."""
    gap = f"{int(hours * 3_600_000_000) - 1} microseconds"  # sessions that touch are one
    rows = writes.where(F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", late)
    found = rows.groupBy("key", F.session_window("at", gap).alias("w")).agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("writes"))
    return found.select("key", F.col("w.start").alias("since"), "last", (F.col("last") + F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600})")).alias("until"), "writes")
