"""Sources and sinks: driver tables, report inputs, corpora with their gates, caches and evaluation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import assert_inside
from ..operators.retrieve import index_health
from .cache import CacheTable

# Fixed value.
APPROVED_HOSTS = ("www.nhs.uk", "nhs.uk", "medlineplus.gov")
WORDS = "doc_id long, page int, text string, x0 double, x1 double, top double, upright boolean, page_width double"
GRIDS = "doc_id long, page int, table_no int, row_no int, cells array<string>"
LINES = "doc_id long, line_no long, line string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def report_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Word boxes, table grids and text lines that page decoders wrote."""
    return tuple(spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in (("words", WORDS), ("grids", GRIDS), ("lines", LINES)))


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def write_corpus(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors in the same rows, so that neither can be older than the other."""
    chunks.write.mode("overwrite").parquet(path)


def write_index_metadata(chunks: DataFrame, path: str, model: str) -> None:
    index_health(chunks).select(F.lit(model).alias("embed_model"), F.lit("cosine").alias("metric"), "dimensions", F.col("chunks").alias("chunk_count")).write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str, hosts: tuple[str, ...] = APPROVED_HOSTS) -> DataFrame:
    """A written corpus; raises if a source lies outside ``hosts`` or a chunk lacks its vector."""
    chunks = assert_inside(spark.read.parquet(path), "url", hosts)
    if not index_health(chunks).first()["healthy"]:
        raise ValueError("chunks and vectors differ")
    return chunks


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache table; an empty one if there is none yet."""
    live = CacheTable(spark, path, schema, [])
    if live.versions():
        live.keys = live.keys_on_disk()
        return live.read()
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def merged_cache(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old entries without a newer one, and the new ones."""
    other = new.select(*(F.col(k).alias(f"_{k}") for k in keys))
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return cache.join(other, match, "left_anti").unionByName(new)


def save_cache(spark: SparkSession, new: DataFrame, keys: list[str], path: str, schema: str) -> bool:
    """Put ``new`` into the versioned cache at ``path``. False if the folder can't be written, which leaves it as it is. Entries
    that lie there as a plain table go into the first version."""
    live = CacheTable(spark, path, schema, keys)
    if not live.versions():
        new = merged_cache(read_cache(spark, path, schema), new, keys)
    return live.save(new)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Accepted generated aliases, a JSON object of alias key to id; none if the file is missing or no such object."""
    empty = spark.createDataFrame([], "alias_key string, test_id string")
    try:
        found = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
        found = found.where("m is not null").select(F.explode("m").alias("alias_key", "test_id")).where("test_id is not null")
        found.schema, found.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    return found


def write_evaluation(rows: DataFrame, summary: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    summary.write.mode("overwrite").json(f"{path}/summary")


def merge_cache(cache: DataFrame, new: DataFrame, keys: list[str], path: str) -> None:
    """Write old entries without a newer one, and the new ones, to ``path`` (not the one ``cache`` is read from)."""
    merged_cache(cache, new, keys).write.mode("overwrite").parquet(path)
