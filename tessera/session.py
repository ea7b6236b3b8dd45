"""The session that tests and the benchmark use; a cluster's own session works as well."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")  # small inputs on all cores
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """df dealt to all cores if it is small by the optimizer's estimate: a small file is one task otherwise, whatever is done with its rows."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most_bytes else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or, where none is set, beside the warehouse's tables (in local mode a temporary one)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        local = spark.sparkContext.master.startswith("local")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera"
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
