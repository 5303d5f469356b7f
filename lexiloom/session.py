"""Session settings that the library expects, and a local session for tests and benchmarks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What a cluster session should carry; sizes of partitions are left to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str | None = None, **extra: str) -> SparkSession:
    """A session on this machine with `cpus` task slots (default: $BENCH_CPUS, else 8)."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lexiloom")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "8g"} | extra
    session = builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, unless PYTHONPATH (which
    they inherit) already leads to it."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _SHIPPED or str(root.parent) in on_path:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lexiloom-"), "lexiloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in root.rglob("*.py"):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


_LOCAL: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset (a local
    session, as in tests) a temporary folder takes its place."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
    return _LOCAL


def written(df, tag: str):
    """`df` as a Parquet table in the shared folder: later plans start from its files, so rounds of a loop
    don't pile up and a lost executor costs no earlier round."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
