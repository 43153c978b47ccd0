"""Session settings and the shared work folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "muster") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder is used only by a local session that names none.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if not folder:
        if current:
            return current
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="muster-")
    if not current:
        sc.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    Later plans start from plain files: a lost executor re-reads them, and their size is
    known, so joins with them are planned from facts.
    """
    path = work_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_in_buckets(df: DataFrame, column: str, parts: int) -> DataFrame:
    """As ``cut_lineage``, and the rows stay dealt by ``column`` into ``parts`` partitions.

    A join on that column with rows dealt the same way then moves neither side.
    """
    spark, name = df.sparkSession, f"muster_step_{uuid.uuid4().hex[:12]}"
    writer = df.write.format("parquet").bucketBy(parts, column).option("path", work_path(spark, "step"))
    writer.saveAsTable(name)
    return spark.table(name)
