"""Session settings and tables written to the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a side of a few narrow columns may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: Spark's setting to remove an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables written since the innermost written_alone() began.
_since: ContextVar[list | None] = ContextVar("_since", default=None)


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf keys use __ for dots."""
    b = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local one only where none is set and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/strandline-checkpoints"


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """df as a Parquet table under spark.checkpoint.dir: cuts lineage and survives the loss of executors."""
    return Scratch(df.sparkSession, label).write(df)


def written_alone(make: Callable[[], DataFrame], label: str = "t") -> DataFrame:
    """What make() returns, as written(); all other tables that were written on the way to it are removed."""
    token = _since.set([])
    own = None
    try:
        df = make()
        own = Scratch(df.sparkSession, label)
        return own.write(df)
    finally:
        others = _since.get()
        _since.reset(token)
        for scratch in others:
            if scratch is not own:
                scratch.keep(0)
        # an outer written_alone removes this one
        if own is not None and _since.get() is not None:
            _since.get().append(own)


@contextmanager
def _cleaned(spark: SparkSession):
    """Writes in it leave no shuffle files: a written table is read from its files only."""
    if not spark.conf.isModifiable(CLEANUP):  # an earlier Spark
        yield
        return
    before = spark.conf.get(CLEANUP)  # with a default of None it is None where nobody has set it
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Written tables of a loop, of which the older ones are removed once nothing needs them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self.base = shared_dir(spark)
        self.paths: list[str] = []
        if _since.get() is not None:
            _since.get().append(self)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/strandline-{self.label}-{uuid.uuid4().hex}"
        with _cleaned(self.spark):
            df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, last: int) -> None:
        """Removes all tables but the last ones."""
        old = self.paths[: max(0, len(self.paths) - last)]
        self.paths = self.paths[len(old) :]
        context = self.spark.sparkContext
        for path in old:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
