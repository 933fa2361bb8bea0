"""Session helpers shared by operators, tests and the benchmark."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as tests and the benchmark use it."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; for loops whose plan would grow with every round.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, on shared storage, so
    that the copy survives the loss of executors. Where that setting is absent only a local
    session gets a folder of its own; on a cluster it is an error. Files go with the last
    reference to them where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexmill-"))
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan in bytes; for a plain scan it is the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only where Catalyst's own estimate is within ``limit_bytes``.

    Beyond the limit the frame is returned unhinted, so that the join shuffles (and AQE may
    still turn it into a broadcast once the true size is known).
    """
    return F.broadcast(df) if plan_bytes(df) <= limit_bytes else df


def collect_bounded(df: DataFrame, text: str, chars: int) -> list[Row] | None:
    """The rows if the texts of a column have at most ``chars`` characters together, else None; ``df`` must end in a shuffle.

    One job: made to depend on the task, the condition stays above the shuffle, which the sum and the rows then share.
    """
    total = df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).scalar()
    rows = df.where(F.when(F.spark_partition_id() >= 0, total <= chars)).collect()
    return rows if rows or df.isEmpty() else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
