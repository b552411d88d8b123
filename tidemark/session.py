"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "tidemark") -> SparkSession:
    """A session for one machine: UTC, AQE, and as many shuffle partitions as cores."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it. Workers on other
    machines need it installed or shipped with --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of the folder `sf_dir`; any path that Spark's readers open."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or in local tests our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.gettempdir() + "/tidemark-shared"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_settled: list[str] = []


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back, for steps that read it several times.
    `sweep` removes such tables."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _settled.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_derived: dict[tuple, DataFrame] = {}


def derived(source: DataFrame, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that follows from `source`'s files, written at its first use in this application and read from then
    on; files of another name, size or time make another."""
    spark = source.sparkSession
    key = spark.sparkContext.applicationId, name, *stamps(source)
    if key not in _derived:
        path = shared_path(spark, name)
        df = make()
        df.write.parquet(path)
        _derived[key] = spark.read.schema(df.schema).parquet(path)
    return _derived[key]


def stamps(source: DataFrame) -> list[tuple[str, int, int]]:
    """(name, size, time) of each input file, from the file system's listing; no row is read."""
    spark = source.sparkSession
    conf, out = spark._jsc.hadoopConfiguration(), []
    for name in source.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = at.getFileSystem(conf).getFileStatus(at)
        out.append((name, status.getLen(), status.getModificationTime()))
    return sorted(out)


def sweep(spark: SparkSession) -> None:
    """Remove all tables of `settled`, when no result that reads them is needed any more."""
    while _settled:
        at = spark._jvm.org.apache.hadoop.fs.Path(_settled.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
