"""Session settings and the folder for what is written between stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "latticeworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow. On a cluster leave ``master`` to spark-submit and set
    ``spark.checkpoint.dir`` to a folder that all executors share."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a session in one JVM may go without and gets a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_dir, "made"):
        shared_dir.made = tempfile.mkdtemp(prefix="latticeworks-")
    return "file://" + shared_dir.made


#: Paths written by ``stage`` and not yet deleted, one list per open ``staging`` scope; the first lives as long as the process.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of the innermost ``staging`` scope, or of the process."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scopes[-1].append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there, and a lost executor costs one stage.

    Shuffle files of the write are removed with it. The table is deleted at the end of the innermost ``staging`` scope, or of
    the process.
    """
    spark = df.sparkSession
    path = place(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    tables.clear()


@contextmanager
def staging() -> Iterator[None]:
    """What ``stage`` writes within is deleted at the end. Frames that read it must have been consumed by then. An operator
    that returns a staged frame calls ``keep_staged`` on it before its own scope ends."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(_scopes.pop())


def keep_staged(df: DataFrame) -> DataFrame:
    """Hands a frame that came from ``stage`` on to the scope around the innermost one."""
    for table in [t for t in _scopes[-1] if t[1] == getattr(df, "staged_at", None)]:
        _scopes[-1].remove(table)
        _scopes[-2].append(table)
    return df


atexit.register(lambda: [_delete(s) for s in _scopes])
