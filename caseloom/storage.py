"""Tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only on a local master, where all tasks see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="caseloom-")
    return _own_folders[context.applicationId]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/caseloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """``df`` with its rank (from 0) in ``order``, and the number of rows.

    A global rank without one task: places within range partitions plus the numbers
    of rows of those before; only these, one a partition, come to the driver.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    ranged = stored(ranged.withColumn("_p", F.shiftright(place, 33).cast("int")).withColumn("_k", place % (1 << 33)), "ranked")
    starts, total = [], 0
    for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect():
        starts.append((r["_p"], total))
        total += r["n"]
    before = F.broadcast(spark.createDataFrame(starts, "_p int, _before long"))
    out = ranged.join(before, "_p").withColumn(name, F.col("_before") + F.col("_k"))
    return out.drop("_p", "_k", "_before"), total
