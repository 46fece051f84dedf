"""Numbers of rows inside keys, where a key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.sources.durable import written


def numbered(rows: DataFrame, key: str, order: str, name: str = "k") -> DataFrame:
    """rows with name, 1 and up inside each key by order (unique in a key).

    Rows are dealt by range of (key, order), so a large key spans several partitions; each numbers its own part of a key, and
    the parts before, one count a partition and key, give the first number.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, key, order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.withColumn("__first", before).where("__first > 0").select(F.col(key).alias("__key"), F.col("__part").alias("__p"), "__first")
    inside = F.row_number().over(Window.partitionBy("__part", key).orderBy(order))
    out = dealt.withColumn(name, inside).join(first, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")), "left")
    return out.withColumn(name, F.col(name) + F.coalesce("__first", F.lit(0))).select(*rows.columns, name)
