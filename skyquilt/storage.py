"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock = threading.Lock()
_writers: dict[int, list] = {}  # by session: how many writes are on their way, and the setting before the first
_roots: list[str] = []  # folders of this process


@contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files go when a query ends: on from the first of the writes that run at once until the last has ended."""
    with _lock:
        state = _writers.setdefault(id(spark), [0, None])
        if not state[0]:
            state[1] = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(CLEANUP, state[1])


def clear(spark: SparkSession) -> None:
    """Remove all tables that this process has written; for the end of a run, when no result that reads them is used any more."""
    while _roots:
        _delete(spark, [_roots.pop()])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


class Scratch:
    """Intermediate tables as Parquet in the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is used if all runs in one process
    on one machine; on a cluster it is an error.  Written tables cut the lineage,
    so a lost executor costs a re-read and not a recomputation, and the shuffle
    files behind a table go as soon as it is written.  Operators remove what their
    result does not read; what it reads stays until ``clear``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.gettempdir() + "/skyquilt-shared"
        self.root = f"{base.rstrip('/')}/skyquilt-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        _roots.append(self.root)

    def place(self) -> str:
        """A path of its own for something that is not written by ``save``."""
        self.paths.append(f"{self.root}/{len(self.paths)}")
        return self.paths[-1]

    def remove(self, *paths: str) -> None:
        """Remove what lies at paths of ``place``."""
        _delete(self.spark, list(paths))

    def save(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = self.place()
        with _cleaning(self.spark):
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def save_counted(self, df: DataFrame, codec: str = "snappy", **counts: Column) -> tuple[DataFrame, dict]:
        """``save``, and aggregates of the rows that are observed as they are written."""
        seen = Observation()
        return self.save(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), codec), seen.get

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables of ``save`` that no later result reads."""
        _delete(self.spark, [t._scratch_path for t in tables])  # noqa: SLF001

    def keep_only(self, *tables: DataFrame) -> None:
        """Remove all tables but these, which a result still reads."""
        kept = {t._scratch_path for t in tables}  # noqa: SLF001
        _delete(self.spark, [p for p in self.paths if p not in kept])


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own, for a result that is read several times."""
    return Scratch(df.sparkSession).save(df)
