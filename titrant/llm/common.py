"""Helpers shared by the corpus operators: the shared folder, written tables, places of rows and null-safe texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a
    temporary one; a cluster has no folder to fall back to, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="titrant-"))
        folder = _own_folder[0]
    return folder.rstrip("/")


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[list[DataFrame]] = []  # tables written in each scratch() that hasn't ended


def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start there, also after an executor is lost.

    The shuffle files of the write go when it ends, and the tables ``done``, written before, that nothing needs any more;
    the table itself goes with the driver, or with the ``scratch`` it was written in.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before) if before is not None else spark.conf.unset(SHUFFLES_GO)
    for old in done:
        forget(old)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    fs, there = _store(out)
    fs.deleteOnExit(there)
    if _open:
        _open[-1].append(out)
    return out


def _store(df: DataFrame) -> tuple:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), path


def forget(df: DataFrame) -> None:
    """Delete a table that ``written`` returned; again is no error."""
    fs, path = _store(df)
    fs.delete(path, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those that are removed from the list."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        for df in _open.pop():
            forget(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_AT_ONCE = 1000  # that an Arrow batch between executor and worker holds


def small_batches(spark: SparkSession) -> None:
    """Bound the buffers of texts on both sides of the workers' pipes: batches of 10,000 texts, Spark's default, leave freed
    memory of many tens of MB for each task with an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_ONCE:
        spark.conf.set(key, ROWS_AT_ONCE)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = ROWS_AT_ONCE) -> Iterator[None]:
    """What is written inside is handed to workers in Arrow batches of ``rows`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def all_partitions(spark: SparkSession) -> Iterator[None]:
    """What is written inside keeps all partitions of its shuffles: rows of few bytes that take long would crowd in few tasks."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """``doc_id``, ``text`` with null read as the empty text, and the columns named in ``more``."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is read straight from files, else a written copy: rows of files have a place."""
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    try:
        if plan == "LogicalRelation":
            docs.metadataColumn("_metadata")
            return docs
    except AnalysisException:
        pass
    return written(docs, "rows")


def place(docs: DataFrame) -> list[Column]:
    """file (a hash of its path) and row (number in it) of each row of a ``stored`` table: no two rows share both."""
    of = docs.metadataColumn("_metadata")
    return [F.xxhash64(of["file_path"]).alias("file"), of["row_index"].alias("row")]


BLOCK = 1 << 15  # rows of a file to a bitmap of 4,096 bytes
MOST = 1 << 14  # bitmaps that are broadcast at once: 64 MB
RUN = MOST // 8  # bitmaps of a file that follow each other and stay together
BRANCHES = 32  # parts of one plan


PLACE = ("_file_of_row", "_row_in_file")


def keep_rows(docs: DataFrame, kept: DataFrame, places: bool = False, others: bool = False) -> DataFrame:
    """The rows of a ``stored`` table whose place is in ``kept`` (file, row), or all ``others``, with all columns and, if asked
    for, their place as the columns ``PLACE``. No text is shuffled: see ``in_places``."""
    names = [f"`{c}`" for c in docs.columns]
    shown = [F.col(c).alias(p) for c, p in zip(("file", "row"), PLACE, strict=True)] if places else []
    return in_places(docs.select(F.struct(*names).alias("all"), *place(docs)), kept, others).select("all.*", *shown)


def in_places(rows: DataFrame, kept: DataFrame, others: bool = False) -> DataFrame:
    """The rows whose columns file and row are a place in ``kept`` (file, row), or all ``others``.

    Kept places become bitmaps, which are dealt into parts by file and by runs of ``RUN`` blocks of a file, so that none has
    more than ``MOST``; each part is broadcast to a scan of its own rows alone. Where no file is longer than a run the
    condition is one on the path, which prunes files when they are listed. A plan has ``BRANCHES`` parts at most: where there
    are more, one job for as many parts appends their rows to a written table. Runs that crowd a part for all that (no deal
    spreads them) are joined by shuffle."""
    spark = rows.sparkSession
    maps = kept.groupBy("file", F.expr(f"row div {BLOCK}").alias("block")).agg(F.bitmap_construct_agg(F.expr(f"row % {BLOCK}")).alias("bits"))
    maps = written(maps, "kept_rows")
    total = maps.count()
    long = total > RUN and not maps.where(F.col("block") >= RUN).isEmpty()
    run = (f" + block div {RUN}", f" + row div {BLOCK * RUN}") if long else ("", "")
    parts = max(1, -(-total // MOST))

    def crowded() -> bool:
        return parts > 1 and maps.groupBy(F.expr(f"pmod(file{run[0]}, {parts})")).count().agg(F.max("count")).first()[0] > MOST

    for _ in range(4):
        if crowded():
            parts *= 2
    hint = (lambda m: m) if crowded() else F.broadcast  # MOST bitmaps at most
    maps = maps.select(F.col("file").alias("of"), "block", "bits", F.expr(f"pmod(file{run[0]}, {parts})").alias("part"))
    byte = f"cast(conv(hex(substring(bits, cast((row % {BLOCK}) div 8 as int) + 1, 1)), 16, 10) as int)"

    def part(k: int) -> DataFrame:
        some = rows.where(F.expr(f"pmod(file{run[1]}, {parts}) = {k}")) if parts > 1 else rows
        found = some.join(hint(maps.where(F.col("part") == k).drop("part")), F.expr(f"file = of and row div {BLOCK} = block"), "left" if others else "inner")
        return found.where(F.expr(f"coalesce(getbit({byte}, cast(row % 8 as int)), 0) = {int(not others)}")).select(*rows.columns)

    some = [reduce(DataFrame.unionByName, map(part, range(k, min(parts, k + BRANCHES)))) for k in range(0, parts, BRANCHES)]
    if len(some) == 1:
        return some[0]
    out = written(some[0], "rows_in_places")
    for more in some[1:]:
        more.write.mode("append").parquet(out.written_path)
    return spark.read.schema(out.schema).parquet(out.written_path)


SMALL = 1 << 20  # rows of a few numbers that may be broadcast: 64 MB


def sized_join(many: DataFrame, one: DataFrame, key: str, deal: str) -> DataFrame:
    """``many`` joined to ``one`` (a row for each ``key``), which is counted: it is broadcast with up to ``SMALL`` rows, beyond
    that hot keys are spread. Both are read twice."""
    if one.count() <= SMALL:
        return many.join(F.broadcast(one), key)
    return spread_join(many, one, key, deal)


HOT = 512


def spread_join(many: DataFrame, one: DataFrame, key: str, deal: str, counts: DataFrame | None = None) -> DataFrame:
    """``many`` joined to ``one`` (a row for each ``key``) with no task getting much over a ``HOT``th of ``many`` for one key.

    Keys with more than a ``HOT``th of the rows, ``HOT`` at most, are counted first and broadcast; their rows of ``many`` are
    dealt by a hash of the columns ``deal`` over as many salts as they need, and ``one`` has a copy for each salt.
    ``counts``: rows of ``many`` by key (key, n), where they are known."""
    share = max(1, many.count() // HOT)
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = F.broadcast(counts.where(F.col("n") > share).select(F.col(key).alias("_hot"), F.expr(f"n div {share} + 1").alias("_salts")))  # HOT rows at most
    dealt = many.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.expr(f"pmod(xxhash64({deal}), coalesce(_salts, 1L))")).drop("_hot", "_salts")
    copies = one.withColumnRenamed(key, "_one").join(hot, F.col("_one") == F.col("_hot"), "left").withColumn("_copy", F.expr("explode(sequence(0L, coalesce(_salts, 1L) - 1L))")).drop("_hot", "_salts")
    return dealt.join(copies, F.expr(f"`{key}` = _one and _salt = _copy")).drop("_one", "_salt", "_copy")
