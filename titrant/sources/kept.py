"""Steps that later ones start from: written where driver and executors can read them, also after an executor is lost."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a local master gets a temporary one; on a cluster that is an
    error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="titrant-"))
        folder = _own_folder[0]
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept_by(df: DataFrame, *columns: str, parts: int | None = None) -> DataFrame:
    """``kept`` with rows of equal ``columns`` in one place, which later steps know: windows, groups and joins by these (and
    more) columns start from there without a shuffle, so several of them can share one reading. Without ``columns`` rows stay
    where they are, which later steps know as well."""
    spark = df.sparkSession
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # a plan that is changed while it runs doesn't tell where its rows lie
    try:
        return kept(df.repartition(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *columns) if columns else df)
    finally:
        spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns worked out once, here: a later filter on them isn't moved to before they are made, where it would
    work them out again for each place that it reads them at."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """What runs inside is handed to workers in Arrow batches of ``rows`` rows at most, that end with the row that reaches ``size``
    bytes."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def fewer_arrow_rows(spark: SparkSession, rows: int) -> None:
    """Workers are handed Arrow batches of ``rows`` rows at most from now on: what is made of pages or texts is read later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)
