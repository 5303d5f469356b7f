"""A cache of results by content: Parquet folders under a manifest, keyed by the MD5 of what they were
made from.

What a writer makes goes into a folder of its own; it counts once a manifest names it. A manifest is a
small numbered file that lists all folders, and making the next number, which the store lets only one
writer do, is the commit. A writer that comes second takes what the first has put in off its own rows
and tries the number after. So every key is there once, readers see whole commits, and a writer that
dies leaves a folder that nothing reads (see vacuum())."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Writers of this process commit one at a time; local file systems look before they create.
_COMMIT = threading.Lock()


def key(*columns: str) -> Column:
    """MD5 of the columns' texts, nulls told from empty ones."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]))


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a maker of its paths."""
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path


def manifest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of the latest manifest (0: none) and the folders that it lists."""
    store, to_path = _store(spark, path)
    place = to_path(f"{path}/_manifest")
    if not store.exists(place):
        return 0, []
    numbers = [int(s.getPath().getName()) for s in store.listStatus(place) if s.getPath().getName().isdigit()]
    if not numbers:
        return 0, []
    latest = max(numbers)
    stream = store.open(to_path(f"{path}/_manifest/{latest:08d}"))
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return latest, [x for x in text.split("\n") if x]


def commit(spark: SparkSession, path: str, number: int, folders: list[str]) -> bool:
    """Makes manifest `number`; False if another writer has made it."""
    store, to_path = _store(spark, path)
    name = to_path(f"{path}/_manifest/{number:08d}")
    with _COMMIT:
        if store.exists(name):
            return False
        try:
            out = store.create(name, False)
        except Exception as e:  # noqa: BLE001  py4j wraps what the store throws
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray("\n".join(folders).encode()))
        out.close()
        return True


def stored(spark: SparkSession, path: str, schema, folders: list[str] | None = None) -> DataFrame:
    """What the cache holds as of the latest manifest (or in the given folders), each key once; nothing if
    it is not there yet."""
    folders = manifest(spark, path)[1] if folders is None else folders
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def put(rows: DataFrame, path: str, seen: tuple[int, list[str]] | None = None) -> None:
    """Adds rows, content_hash among their columns and unique, whose keys the manifest `seen` (the latest
    unless given) lacks. Rows whose keys other writers commit in the meantime are left out."""
    spark = rows.sparkSession
    number, folders = manifest(spark, path) if seen is None else seen
    own = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{own}")
    while not commit(spark, path, number + 1, [*folders, own]):
        latest, now = manifest(spark, path)
        others = stored(spark, path, rows.schema, [f for f in now if f not in folders]).select("content_hash")
        mine = spark.read.schema(rows.schema).parquet(f"{path}/{own}")
        own = f"v-{uuid.uuid4().hex}"
        mine.join(others, "content_hash", "left_anti").write.parquet(f"{path}/{own}")
        number, folders = latest, now


def through(df: DataFrame, columns: list[str], path: str, make: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """`df` with what `make` gives for its content, each content made once and kept under `path`.

    `make` takes rows (content_hash, *columns), distinct by content, and returns rows of `schema`,
    content_hash among them. Only content that the cache lacks is handed to it; what it makes is
    committed before it is read back."""
    spark = df.sparkSession
    keyed = df.withColumn("content_hash", key(*columns))
    distinct = keyed.groupBy("content_hash").agg(*[F.first(c).alias(c) for c in columns])
    seen = manifest(spark, path)
    missing = distinct.join(stored(spark, path, schema, seen[1]).select("content_hash"), "content_hash", "left_anti")
    put(make(missing), path, seen)
    return keyed.join(stored(spark, path, schema), "content_hash", "left").drop("content_hash")


def compact(spark: SparkSession, path: str, schema) -> bool:
    """Puts all folders into one; False if another writer committed meanwhile (nothing is lost: try again)."""
    number, folders = manifest(spark, path)
    if len(folders) < 2:
        return True
    own = f"v-{uuid.uuid4().hex}"
    stored(spark, path, schema, folders).write.parquet(f"{path}/{own}")
    return commit(spark, path, number + 1, [own])


def vacuum(spark: SparkSession, path: str, older_than: float = 7 * 86_400) -> int:
    """Deletes folders that the latest manifest doesn't list and that were last written more than
    `older_than` seconds ago (running readers and writers may still need younger ones): their number."""
    import time

    store, to_path = _store(spark, path)
    listed, gone = set(manifest(spark, path)[1]), 0
    for s in store.listStatus(to_path(path)):
        name = s.getPath().getName()
        if name.startswith("v-") and name not in listed and s.getModificationTime() / 1000 < time.time() - older_than:
            store.delete(s.getPath(), True)
            gone += 1
    return gone
