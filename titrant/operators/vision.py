"""Extraction by a generator: page images in batches of four, and whole texts where no image was read.

Page images are binary rows that a page decoder wrote. A report's pages are dealt by their order into batches of ``PAGES``;
each batch is one call and one row of outcomes, with the range of its pages and, if the call or its answer failed, the reason,
so that a bad batch costs nothing but its own pages. Outcomes are kept before anything reads them: no call is made twice. Work
is spread by batch, so the pages of a long report are read by many tasks at once.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_text, strip
from ..sources.kept import arrow_rows, kept_by
from .extract import clean_extracted
from .results import dedupe

PAGES = 4
AT_A_TIME, BYTES = 1000, 16 << 20  # calls that a worker is handed at once, and their images' size beyond which no other is added
# What a generator is told, and the answer's form.
IMAGES_ASKED = ("Extract all clinical lab test results visible in these images (report pages ", ").")
TEXT_ASKED = ("Extract all medical test results from this text:\n---\n", "\n---")
FIELDS = ("raw_name", "value", "unit", "ref_range", "status")
#: (text, images as data URLs) to an answer: JSON text with a list ``results`` of objects with the fields.
Reader = Callable[[str, list[str]], str]


def page_batches(pages: DataFrame) -> DataFrame:
    """doc_id, batch (from 0), page_range, images: pages (doc_id, page, image) in order, ``PAGES`` at a time; pages without an
    image are none."""
    order = Window.partitionBy("doc_id").orderBy("page", "image")
    ahead = F.array("image", *(F.lead("image", k).over(order) for k in range(1, PAGES)))
    dealt = pages.where("image is not null").select("doc_id", F.row_number().over(order).alias("_at"), ahead.alias("_i")).where(F.col("_at") % PAGES == 1)
    images = F.filter("_i", lambda i: i.isNotNull())
    page_range = F.concat(F.col("_at").cast("string"), F.lit("-"), (F.col("_at") + F.size("images") - 1).cast("string"))
    return dealt.select("doc_id", F.floor((F.col("_at") - 1) / PAGES).cast("long").alias("batch"), "_at", images.alias("images")).select("doc_id", "batch", page_range.alias("page_range"), "images")


def data_url(image: bytes) -> str:
    return "data:image/png;base64," + base64.b64encode(image).decode()


def _asked(reader: Reader, text: str, images: list[str]) -> tuple[str | None, str | None]:
    """Answer and reason of failure of one call."""
    try:
        answer = reader(text, images)
        return answer if answer is None else answer.encode().decode(), None  # nothing but text that can be written
    except Exception as e:
        return None, f"{type(e).__name__}: {e}".encode(errors="replace").decode()


def _outcomes(asked: DataFrame, reader: Reader, at_once: int | None) -> DataFrame:
    """Kept outcomes of rows (doc_id, batch, page_range, text, images), each one call: doc_id, batch, page_range, results (read out of
    the answer once; null: it has none), failure; those of a report lie in one place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [_asked(reader, text.as_py(), [data_url(i) for i in images.as_py()]) for text, images in zip(batch["text"], batch["images"], strict=True)]
            told = [pa.array(c, pa.string()) for c in zip(*said, strict=True)] if said else [pa.array([], pa.string())] * 2
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *told], [*names, "answer", "failure"])

    names = ["doc_id", "batch", "page_range"]
    asked = asked.repartition(at_once, "doc_id", "batch") if at_once else asked
    with arrow_rows(asked.sparkSession, AT_A_TIME, BYTES):
        said = asked.mapInArrow(each, "doc_id long, batch long, page_range string, answer string, failure string")
        return kept_by(said.select(*names, _results("answer").alias("results"), "failure"), "doc_id")


def read_images(batches: DataFrame, reader: Reader, at_once: int | None = None) -> DataFrame:
    """Outcomes of ``page_batches``; ``at_once``: how many tasks call the generator."""
    asked = F.concat(F.lit(IMAGES_ASKED[0]), "page_range", F.lit(IMAGES_ASKED[1]))
    return _outcomes(batches.select("doc_id", "batch", "page_range", asked.alias("text"), "images"), reader, at_once)


def read_texts(texts: DataFrame, reader: Reader, at_once: int | None = None) -> DataFrame:
    """Outcomes of whole texts (doc_id, text), one call each; blank texts are not asked about."""
    some = texts.where(F.coalesce(strip("text"), F.lit("")) != "")
    asked = F.concat(F.lit(TEXT_ASKED[0]), "text", F.lit(TEXT_ASKED[1]))
    none = F.lit(None).cast("string")
    return _outcomes(some.select("doc_id", F.lit(0).cast("long").alias("batch"), none.alias("page_range"), asked.alias("text"), F.array().cast("array<binary>").alias("images")), reader, at_once)


def _results(answer: Column | str) -> Column:
    return F.from_json(json_text(answer), "results array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>")["results"]


def outcomes(read: DataFrame) -> DataFrame:
    """doc_id, batch, page_range, ok, n_results, failure: each call; an answer without a list of results is a failure."""
    failure = F.coalesce("failure", F.when(F.col("results").isNull(), F.lit("no results in the answer")))
    n = F.when(F.col("results").isNotNull(), F.size("results")).otherwise(0)
    return read.select("doc_id", "batch", "page_range", failure.isNull().alias("ok"), n.alias("n_results"), failure.alias("failure"))


def extracted(read: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows out of the answers: cleaned, named, with page_range, and deduplicated in each report by pages, then place in the
    answer. seq: tier, page (the batch's first), place."""
    found = read.select("doc_id", "batch", "page_range", F.posexplode("results").alias("_at", "_r")).where("_r is not null")
    seq = F.struct(F.lit(3).alias("tier"), (F.col("batch") * PAGES + 1).cast("int").alias("page"), F.col("_at").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    rows = clean_extracted(found.select("doc_id", "page_range", seq.alias("seq"), "_r.*"), aliases)
    return dedupe(rows, within=("doc_id",))


def holistic(pages: DataFrame, texts: DataFrame, aliases: DataFrame, images: Reader, text: Reader, at_once: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, tiers (doc_id, tier: vision, llm_text or failed) and outcomes of reports: the images' rows, or where a report has
    none of them the text's. pages: doc_id, page, image; texts: doc_id, text."""
    seen = read_images(page_batches(pages), images, at_once)
    by_image = kept_by(extracted(seen, aliases))
    docs = pages.select("doc_id").unionByName(texts.select("doc_id")).distinct()
    left = texts.join(by_image.select("doc_id").distinct(), "doc_id", "left_anti")
    told = read_texts(left, text, at_once)
    by_text = kept_by(extracted(told, aliases))
    rows = by_image.withColumn("tier", F.lit("vision")).unionByName(by_text.withColumn("tier", F.lit("llm_text")))
    tiers = docs.join(rows.groupBy("doc_id").agg(F.first("tier").alias("tier")), "doc_id", "left").withColumn("tier", F.coalesce("tier", F.lit("failed")))
    calls = outcomes(seen).withColumn("tier", F.lit("vision")).unionByName(outcomes(told).withColumn("tier", F.lit("llm_text")))
    return rows, tiers, calls
