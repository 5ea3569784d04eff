"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "probatum", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # small tables are multiplied later on (folds, permutations), so they stay spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``; a machine-local one is set only for local masters."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            shared = tempfile.mkdtemp(prefix="probatum-ckpt-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # of Spark 4.1; unknown to older ones, without harm


def cut_lineage(df: DataFrame, free: bool = False) -> DataFrame:
    """Reliable checkpoint in the shared folder. ``free``: the shuffles it took leave the disk at once, not when the driver
    happens to collect its garbage."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    if not free:
        return df.checkpoint(eager=True)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting as it is when made
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
