"""Whole flows: manual entry, report upload, corpus build, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, dims, evaluate, explain, extract, results, retrieve, synonyms, vision
from ..operators.verify import keep_verified
from ..sources.cache import CacheTable
from ..sources.kept import kept, kept_by, shared_folder
from ..sources.tables import write_evaluation

UNIT = 10  # ids that are put into a cache together


def manual_entry(spark: SparkSession, entries: DataFrame, sex: Column | None = None) -> DataFrame:
    """Typed rows (raw_name, value, unit) with id, known, bounds and status."""
    ref = dims.reference(spark)
    return results.finalise(extract.manual_rows(entries, dims.aliases(spark, ref)), ref, sex)


def upload(spark: SparkSession, grids: DataFrame, words: DataFrame, lines: DataFrame, extracted: DataFrame, sex: Column | None = None, tiers: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """Finalised rows of reports out of their decoded pages and of rows that a generator extracted.

    extracted: doc_id, seq (as of the tiers), raw_name, value, unit, ref_range, status; only rows that the report's own
    text bears out are kept. tiers: doc_id, tier and ocr, as ``cascade`` has them.
    """
    ref = dims.reference(spark)
    alias = dims.aliases(spark, ref)
    grids, words, lines = (kept_by(rows, "doc_id") for rows in (grids, words, lines))  # read once, report by report
    pages = extract.carry_page(lines).select("doc_id", F.col("page").cast("int").alias("page"), F.col("line").alias("text"))
    tables = extract.structured_tables(grids, words, pages, alias).drop("first_seq")
    claims = extract.clean_extracted(extracted, alias).withColumn("claim_id", F.xxhash64("seq", "raw_name", "value"))
    answered = extracted.select("doc_id", F.lit("vision").alias("tier")).distinct() if tiers is None else tiers
    claims = keep_verified(claims, lines, text="line", line_no="line_no").drop("claim_id")
    docs = lines.select("doc_id").unionByName(grids.select("doc_id")).unionByName(words.select("doc_id")).distinct().join(answered, "doc_id", "left")
    rows = extract.cascade(tables, claims, extract.text_rows(lines, alias), docs, mode)
    rows = rows if "status" in rows.columns else rows.withColumn("status", F.lit(None).cast("string"))
    return results.finalise(rows, ref, sex)


def read_and_upload(spark: SparkSession, grids: DataFrame, words: DataFrame, lines: DataFrame, pages: DataFrame, images: vision.Reader, text: vision.Reader, sex: Column | None = None, at_once: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``upload`` with the generators' tiers worked out here: reports whose tables have too few rows are read by image, then by
    text. Finalised rows and the outcomes of all calls. pages: doc_id, page, image."""
    ref = dims.reference(spark)
    alias = dims.aliases(spark, ref)
    texts = extract.carry_page(lines)
    tables = extract.structured_tables(grids, words, texts.select("doc_id", F.col("page").cast("int").alias("page"), F.col("line").alias("text")), alias)
    enough = tables.groupBy("doc_id").count().where(F.col("count") >= extract.LEAST_ROWS).select("doc_id")
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    poor = kept(pages.select("doc_id").unionByName(whole.select("doc_id")).distinct().join(enough, "doc_id", "left_anti"))
    rows, tiers, calls = vision.holistic(pages.join(poor, "doc_id"), whole.join(poor, "doc_id"), alias, images, text, at_once)
    named = rows.select("doc_id", "seq", "raw_name", "value", "unit", "ref_range", "status")
    return upload(spark, grids, words, lines, named, sex, tiers.where("tier <> 'failed'")), calls


def build_corpus(pages: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors, and the pages that gave no section. pages: page_id, html; sources: page_id, url, source, test_ids, seq."""
    sectioned = corpus.page_sections(pages)
    made = retrieve.embed(corpus.chunks(sectioned, sources), "embed_text")
    return made, pages.select("page_id").join(sectioned, "page_id", "left_anti")


def _passages(tests: DataFrame, chunks: DataFrame, names: str, ids: str) -> DataFrame:
    """slot and the passages for each of tests (slot, a name and a grounding id): each different pair is looked up once."""
    pairs = tests.select(F.col(names).alias("name"), F.col(ids).alias("test_id")).distinct().withColumn("query_id", F.xxhash64("name", "test_id"))
    queries = retrieve.embed(pairs.withColumn("_q", retrieve.query_text("name", "test_id")), "_q")
    found = retrieve.hybrid(queries, chunks, explain.PASSAGES)
    return tests.select("slot", F.xxhash64(names, ids).alias("query_id")).join(found, "query_id").drop("query_id")


ENTRY = "test_id string, specimen string, what_it_measures string, lifestyle_suggestions array<string>, gp_question string"
MEASURE = "test_id string, what_it_measures string"


def explanation_cache(spark: SparkSession, path: str) -> CacheTable:
    return CacheTable(spark, path, ENTRY, ["test_id", "specimen"])


def _grounded_tests(spark: SparkSession, rows: DataFrame, reference: DataFrame, chunks: DataFrame) -> DataFrame:
    tests = dims.ground(rows, spark)
    return explain.bundle(tests, reference, _passages(tests, chunks, "raw_name", "grounding_id"))


def explain_results(spark: SparkSession, rows: DataFrame, reference: DataFrame, chunks: DataFrame, cache: DataFrame, report: str = "report_id", generator: explain.Generator = explain.offline_generator, **how) -> DataFrame:
    """Finalised rows (slot, report, test_id, raw_name, specimen, unit) with explanations checked against their sources.
    generator: ``policy.generator`` of a chain, or the one built in; how: as ``explain`` has it."""
    return explain.explain(_grounded_tests(spark, rows, reference, chunks), cache, report, generator, **how)


def explain_and_cache(spark: SparkSession, rows: DataFrame, reference: DataFrame, chunks: DataFrame, path: str, report: str = "report_id", generator: explain.Generator = explain.offline_generator, **how) -> DataFrame:
    """``explain_results`` with the cache at ``path``: what is new and passed is put there, so a later report with the same tests
    asks for nothing. Where the folder can't be written, the rows come all the same."""
    cache = explanation_cache(spark, path)
    rows = kept(explain.judged(_grounded_tests(spark, rows, reference, chunks), kept(cache.read()), report, generator, **how))
    new = explain.new_entries(rows)
    if not new.isEmpty():
        cache.save(new)
    return explain.shown(rows)


def _precomputed(spark: SparkSession, stubs: DataFrame, reference: DataFrame, chunks: DataFrame, generator: explain.Generator, measures_only: bool) -> DataFrame:
    tests = _grounded_tests(spark, stubs.withColumn("slot", F.xxhash64("test_id")), reference, chunks).where("grounded")
    answers = kept(explain.generate(tests.withColumn("batch", F.col("slot")), generator))
    return explain.verified_measures(answers, tests) if measures_only else explain.verified_details(answers, tests)


def precompute(spark: SparkSession, reference: DataFrame, chunks: DataFrame, cache: DataFrame, generator: explain.Generator = explain.offline_generator, measures_only: bool = False, force: bool = False) -> DataFrame:
    """New cache entries (test_id, specimen and the three fields; with ``measures_only`` test_id and what_it_measures) for the
    ids that the corpus covers and ``cache`` lacks. Answers that their context doesn't bear out are left out."""
    return _precomputed(spark, explain.stubs(chunks, cache, force), reference, chunks, generator, measures_only)


def precompute_into(spark: SparkSession, reference: DataFrame, chunks: DataFrame, path: str, generator: explain.Generator = explain.offline_generator, measures_only: bool = False, force: bool = False, unit: int = UNIT) -> CacheTable:
    """``precompute`` in units of ``unit`` ids, each put into the cache at ``path`` before the next begins: a run that fails has
    lost one unit's answers at most, and the next run asks for what the cache lacks.

    The ids to do are files of one unit each, read as a stream of one file a batch; a batch that is run again leaves out what the
    cache has by then (with ``force`` it repeats its unit)."""
    cache = CacheTable(spark, path, MEASURE, ["test_id"]) if measures_only else explanation_cache(spark, path)
    todo = explain.stubs(chunks, _as_entries(cache.read()), force).select("test_id")
    work = f"{shared_folder(spark)}/precompute-{uuid.uuid4().hex}"
    todo.write.option("maxRecordsPerFile", unit).parquet(f"{work}/ids")

    def one(rows: DataFrame, number: int) -> None:
        ids = spark.createDataFrame([(r["test_id"],) for r in rows.collect()], "test_id string")  # a unit at most
        if not force:
            ids = results.cache_misses(ids.withColumn("specimen", F.lit(None).cast("string")), _as_entries(cache.read()), ["test_id", "specimen"]).select("test_id")
        new = kept(_precomputed(spark, explain.as_stubs(ids), reference, chunks, generator, measures_only))
        if not new.isEmpty():
            cache.save(new)

    stream = spark.readStream.schema("test_id string").option("maxFilesPerTrigger", 1).parquet(f"{work}/ids")
    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start().awaitTermination()
    return cache


def _as_entries(cache: DataFrame) -> DataFrame:
    return cache if "specimen" in cache.columns else cache.withColumn("specimen", F.lit(None).cast("string"))


def generate_synonyms(chunks: DataFrame, asked: DataFrame, existing: DataFrame, propose, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Proposals (test_id, alias) of ``propose`` (a function of test_id, topics) for ids not asked for yet, with those asked
    before, and the judgement of every key. asked: test_id, alias."""
    todo = synonyms.unasked(synonyms.topics(chunks), asked, force)
    proposals = kept(propose(todo).select("test_id", "alias"))
    every = proposals if force else asked.select("test_id", "alias").unionByName(proposals)
    return every, synonyms.judged(every, existing)


def summary(explained: DataFrame, report: str = "report_id") -> DataFrame:
    one = explained.withColumn("_s", F.get(F.filter("lifestyle_suggestions", lambda x: F.trim(x) != ""), F.lit(0)))
    return results.report_summary(one, report, "slot", "gp_question", "_s")


def evaluate_cases(spark: SparkSession, cases: DataFrame, reference: DataFrame, chunks: DataFrame, path: str, generator: explain.Generator = explain.offline_generator, **how) -> tuple[DataFrame, DataFrame]:
    """Typed cases (slot, category, raw_name, value, unit), each a report of its own, explained and scored: rows by case and the
    roll-up by category, both also written below ``path``. Grades and completeness are of the texts that a patient would see."""
    rows = results.finalise(extract.manual_rows(cases, dims.aliases(spark, ref := dims.reference(spark))), ref).withColumn("report_id", F.col("slot"))
    rows = rows if "specimen" in rows.columns else rows.withColumn("specimen", F.lit(None).cast("string"))
    explained = explain_results(spark, rows, reference, chunks, spark.createDataFrame([], ENTRY), "report_id", generator, **how)
    scored = evaluate.score_explanations(explained).withColumns({"grounding_pass": ~F.col("degraded") & ~F.col("ungrounded"), "completeness": F.col("complete")})
    scored = kept(scored.select("category", "slot", "raw_name", "value", "unit", "degraded", "ungrounded", "grounding_pass", "completeness", F.round("fk_grade", 1).alias("fk_grade")))
    total = evaluate.rollup_metrics(scored, "category", F.col("grounding_pass"), F.col("completeness"), F.col("fk_grade"))
    write_evaluation(scored.orderBy("slot"), total, path)
    return scored, total


def evaluate_explanations(explained: DataFrame, category: str) -> DataFrame:
    rows = evaluate.score_explanations(explained)
    return evaluate.rollup_metrics(rows, category, F.col("grounded") & ~F.col("degraded"), F.col("complete"), F.col("fk_grade"))
