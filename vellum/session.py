"""Session settings and stored tables that the operators rely on."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use underscores for dots."""
    b = SparkSession.builder.appName("vellum").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("_", "."), value)
    return b.getOrCreate()


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: Shuffle files of a finished write are removed at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a local one only in local mode where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellum-ckpt-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, *done: DataFrame, by: str | None = None) -> DataFrame:
    """Write a frame as a compressed table to the shared checkpoint folder and read it from there: lineage is cut, columns
    can be pruned, and the copy outlives executors. Tables given as done are removed, as are the shuffle files of the
    write; what is left is removed by ``release`` or when the session's process ends. ``by`` names a column of few values
    by which the table is partitioned."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if not _left:
        atexit.register(release, spark)
    _left.add(path)
    free(*done)
    return out


_left: set[str] = set()


def free(*tables: DataFrame) -> None:
    """Remove stored tables that no later step reads."""
    for t in tables:
        _remove(t.sparkSession.sparkContext._jvm, t._stored_at)
        _left.discard(t._stored_at)


def release(spark: SparkSession) -> None:
    """Remove every stored table of this process; frames that were made from them can't be read after."""
    for path in list(_left):
        _remove(spark.sparkContext._jvm, path)
        _left.discard(path)


def _remove(jvm, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
