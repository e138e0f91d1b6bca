"""Explanations: grounding bundles, batches, cache, a pluggable generator, verification and assembly."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import coerce_details, numbers_in, or_null, patient_text, strip, stub_name
from ..sources.kept import kept
from .results import assign_batches, cache_misses, reassemble
from .retrieve import covered_ids
from .verify import grounded, other_test_named

PASSAGES, PASSAGE_CHARS, BATCH, WAVES = 2, 550, 6, 3
# Texts where there is no source, no answer, or an answer that its source doesn't bear out.
SOURCE = "NHS UK / NIH MedlinePlus"
NOT_COVERED = "Not covered by NHS UK / NIH MedlinePlus"
NOT_VERIFIED = "Not independently verified"
NO_SOURCE = ("NHS UK and NIH MedlinePlus reference material for ", " was not available, so no explanation has been generated.")
NO_ADVICE = ("Discuss this test with your GP or healthcare provider.", "Avoid making dietary or medication changes without professional advice.")
ADVICE = "Maintain balanced nutrition and regular physical activity."
ASK_INSTEAD = "What questions should I discuss with my GP regarding this test?"
DISCLAIMER = "Educational information only. Consult your GP."
Generator = Callable[[pd.DataFrame], pd.DataFrame]


def bundle(tests: DataFrame, reference: DataFrame, passages: DataFrame) -> DataFrame:
    """tests (slot, grounding_id, ...) with text, sources, source_label, grounded and has_rag.

    reference: test_id, source, plain_english; passages: slot, rank, text, source, url.
    """
    shown = passages.where((F.col("rank") <= PASSAGES) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    line = F.concat(F.lit("("), F.coalesce("source", F.lit(SOURCE)), F.lit(") "), F.substring(F.trim("text"), 1, PASSAGE_CHARS))
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), F.coalesce("source", F.lit(SOURCE)).alias("label"), "url")))
    found = shown.groupBy("slot").agg(listed.alias("_p"))
    curated = reference.where("coalesce(plain_english, '') != ''").select(F.col("test_id").alias("_ref"), F.coalesce("source", F.lit(SOURCE)).alias("_label"), "plain_english")
    out = tests.join(F.broadcast(curated), F.col("grounding_id") == F.col("_ref"), "left").join(found, "slot", "left")
    p = F.coalesce("_p", F.array().cast(found.schema["_p"].dataType))
    own = F.when(F.col("_ref").isNotNull(), F.array(F.concat(F.lit("("), F.col("_label"), F.lit(") "), F.col("plain_english")))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(own, F.transform(p, lambda x: x["line"]))
    labels = F.array_sort(F.array_distinct(F.concat(F.when(F.col("_ref").isNotNull(), F.array("_label")).otherwise(F.array().cast("array<string>")), F.transform(p, lambda x: x["label"]))))
    linked = F.filter(F.transform(p, lambda x: F.struct(x["label"].alias("label"), x["url"].alias("url"))), lambda x: x["url"].isNotNull())
    first = F.filter(linked, lambda x, i: F.array_position(F.transform(linked, lambda y: y["url"]), x["url"]) == i + 1)
    return out.withColumns({
        "text": F.array_join(lines, "\n"),
        "sources": first,
        "source_label": F.when(F.size(labels) > 0, F.array_join(labels, " / ")).otherwise(F.lit(SOURCE)),
        "grounded": F.size(lines) > 0,
        "has_rag": F.size(p) > 0,
    }).drop("_ref", "_label", "plain_english", "_p")


def offline_generator(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for a language model: the context's first sentences and fixed general advice."""
    wim = batch["text"].str.replace(r"^\([^)]*\) ", "", regex=True).str.split("\n").str[0].str.slice(0, 300)
    return pd.DataFrame({
        "slot": batch["slot"],
        "what_it_measures": wim,
        "lifestyle_suggestions": [["Keep a balanced diet", "Stay active"]] * len(batch),
        "gp_question": "What does my " + batch["raw_name"] + " measure?",
    })


GENERATED = "slot long, what_it_measures string, lifestyle_suggestions array<string>, gp_question string"
FIELDS = ["what_it_measures", "lifestyle_suggestions", "gp_question"]


def generate(tests: DataFrame, generator: Generator = offline_generator, report: str | None = None) -> DataFrame:
    """Answers for tests (slot, test_id, raw_name, text, batch, wave); a generator gets one batch of one report at a time and
    may leave rows out."""
    rows = tests if "wave" in tests.columns else tests.withColumn("wave", F.lit(0))
    kept_columns = ["slot", "test_id", "raw_name", "text", "batch", "wave"]
    if generator is offline_generator:  # row by row: no need to bring batches together
        return rows.select(*kept_columns).mapInPandas(lambda frames: map(generator, frames), GENERATED)
    rows = rows.select(*kept_columns, (F.col(report) if report else F.lit(0)).alias("_report"))
    return rows.groupBy("_report", "batch", "wave").applyInPandas(lambda frame: generator(frame[kept_columns]), GENERATED)


TRACED = GENERATED + ", opened map<string, double>"


def _wave(tests: DataFrame, generator: Generator, report: str) -> tuple[DataFrame, Generator]:
    """Kept answers of one wave and the generator for the next: where it tells what its tasks have shut, that is known there."""
    if not hasattr(generator, "traced"):
        return kept(generate(tests, generator, report)), generator
    rows = tests.select("slot", "test_id", "raw_name", "text", "batch", "wave", F.col(report).alias("_report"))
    asked = kept(rows.groupBy("_report", "batch", "wave").applyInPandas(lambda frame: generator.traced(frame.drop(columns="_report")), TRACED))
    opened = asked.where("slot is null").select(F.explode("opened").alias("entry", "until")).groupBy("entry").agg(F.max("until").alias("until"))
    shut = {r["entry"]: r["until"] for r in opened.collect()}  # entries of one chain
    return asked.where("slot is not null").drop("opened"), generator.knowing(shut)


def in_waves(asked: DataFrame, generator: Generator, report: str, waves: int = WAVES, pause: Callable[[], None] | None = None) -> DataFrame:
    """Answers to ``asked`` (with batch, from 0 in each report), what is missing being asked again in new batches: in the
    second wave behind the reserved chain, in the last after ``pause`` (a wait for cooldowns). Waves are kept, so that no
    answer is asked for twice, and a provider that a task of one wave found down is asked by no task of the next."""
    answers, generator = _wave(asked.withColumn("wave", F.lit(0)), generator, report)
    missing = asked.join(answers.select("slot"), "slot", "left_anti")
    first = asked.groupBy(report).agg((F.max("batch") + 1).alias("_first"))
    for wave in range(1, waves):
        if missing.isEmpty():
            break
        if wave == waves - 1 and pause:
            pause()
        again = assign_batches(missing.drop("batch"), [report], ["slot"], BATCH).join(first, report)
        again = again.withColumns({"batch": F.col("batch") + F.col("_first"), "wave": F.lit(wave)}).drop("_first")
        more, generator = _wave(again, generator, report)
        answers = answers.unionByName(more)
        missing = asked.join(answers.select("slot"), "slot", "left_anti")
    return answers


def parse_answers(answers: DataFrame) -> DataFrame:
    """slot and the coerced fields of answers (slot, json)."""
    return answers.select("slot", coerce_details("json").alias("_d")).select("slot", "_d.*").drop("disclaimer")


def judged(tests: DataFrame, cache: DataFrame, report: str = "report_id", generator: Generator = offline_generator, precomputed: DataFrame | None = None, waves: int = WAVES, pause: Callable[[], None] | None = None) -> DataFrame:
    """One row per slot: the fields where they pass the checks, null where they don't, with degraded, ungrounded and generated
    (whether the fields are new).

    tests: slot, report, test_id, specimen, raw_name, unit and a bundle; cache: test_id, specimen and the three fields.
    Batches of six are by place over all tests; only grounded tests that the cache lacks reach the generator. An answer
    that the context doesn't bear out is dropped whole; a question that names another test of the batch is replaced.
    """
    tests = assign_batches(tests, [report], ["slot"], BATCH)
    asked = cache_misses(tests.where("grounded"), cache, ["test_id", "specimen"])
    new = in_waves(asked, generator, report, waves, pause)
    if precomputed is not None:
        known = precomputed.select(F.col("test_id").alias("_t"), F.col("what_it_measures").alias("_w"))
        new = new.join(asked.select("slot", "test_id"), "slot").join(known, F.col("test_id") == F.col("_t"), "left")
        new = new.withColumn("what_it_measures", F.coalesce("_w", "what_it_measures")).select("slot", *FIELDS)
    held = cache.select(F.col("test_id").alias("_t"), F.col("specimen").alias("_s"), *FIELDS)
    hits = tests.where("grounded").select("slot", "test_id", "specimen").join(held, F.col("test_id").eqNullSafe(F.col("_t")) & F.col("specimen").eqNullSafe(F.col("_s"))).select("slot", *FIELDS)
    told = new.withColumn("generated", F.lit(True)).unionByName(hits.withColumn("generated", F.lit(False)))
    told = told.select("slot", "generated", or_null(strip("what_it_measures")).alias(FIELDS[0]), *(F.filter(F.transform(FIELDS[1], lambda x: strip(x)), lambda x: x != "").alias(FIELDS[1]),), or_null(strip("gp_question")).alias(FIELDS[2]))
    told = told.withColumn(FIELDS[1], F.when(F.size(FIELDS[1]) > 0, F.col(FIELDS[1])))
    names = tests.where("grounded").groupBy(report, "batch").agg(F.collect_list(F.struct("slot", "raw_name", "test_id")).alias("_names"))  # six at most
    rows = tests.join(names, [report, "batch"], "left").join(told, "slot", "left")
    others = F.transform(F.filter(F.array_sort("_names"), lambda n: ~n["test_id"].eqNullSafe(F.col("test_id"))), lambda n: n["raw_name"])
    some = F.coalesce(*(F.col(c).cast("string") for c in FIELDS)).isNotNull()
    check = grounded(patient_text(*FIELDS), "text", numbers_in("unit"))
    rows = rows.withColumns({"_ok": F.col("grounded") & some & F.coalesce(check["ok"], F.lit(False)), "_other": other_test_named("gp_question", "raw_name", others)})
    rows = rows.withColumn("gp_question", F.when(F.col("_other").isNull(), F.col("gp_question")).otherwise(ASK_INSTEAD))
    rows = rows.withColumns({"degraded": F.col("grounded") & ~F.col("_ok"), "ungrounded": ~F.col("grounded"), "generated": F.coalesce("generated", F.lit(False)), **{c: F.when(F.col("_ok"), F.col(c)) for c in FIELDS}})
    return rows.drop("_names", "_ok", "_other")


def new_entries(rows: DataFrame) -> DataFrame:
    """Cache entries (test_id, specimen and the three fields) of the rows of ``judged`` that are new and passed; of one test and
    specimen the first slot's."""
    passed = rows.where("generated and grounded and not degraded")
    one = passed.groupBy("test_id", "specimen").agg(F.min_by(F.struct(*FIELDS), "slot").alias("_e"))
    return one.select("test_id", "specimen", "_e.*")


def shown(rows: DataFrame) -> DataFrame:
    """Rows of ``judged`` with fallback copy where a field is missing. Sources are cited only for text that passed."""
    missing, name = F.col("ungrounded"), F.col("raw_name")
    no_urls = F.array().cast(rows.schema["sources"].dataType) if "sources" in rows.columns else None
    return rows.drop("generated").withColumns({
        "what_it_measures": F.coalesce("what_it_measures", F.when(missing, F.concat(F.lit(NO_SOURCE[0]), name, F.lit(NO_SOURCE[1]))).otherwise(F.concat(F.lit("Evaluates what "), name, F.lit(" measures in the body.")))),
        "lifestyle_suggestions": F.coalesce("lifestyle_suggestions", F.when(missing, F.array(*map(F.lit, NO_ADVICE))).otherwise(F.array(F.lit(ADVICE)))),
        "gp_question": F.coalesce("gp_question", F.concat(F.lit("Could you explain what my "), name, F.lit(" test involves?"))),
        "disclaimer": F.lit(DISCLAIMER),
        **({"source_label": F.when(missing, NOT_COVERED).when(F.col("degraded"), NOT_VERIFIED).otherwise(F.col("source_label"))} if "source_label" in rows.columns else {}),
        **({"sources": F.when(missing | F.col("degraded"), no_urls).otherwise(F.col("sources"))} if no_urls is not None else {}),
    })


def explain(tests: DataFrame, cache: DataFrame, report: str = "report_id", generator: Generator = offline_generator, precomputed: DataFrame | None = None, waves: int = WAVES, pause: Callable[[], None] | None = None) -> DataFrame:
    """One row per slot in order: explanations that pass the checks, else fallback copy; degraded and ungrounded flags."""
    return shown(judged(tests, cache, report, generator, precomputed, waves, pause))


def allowed_numbers(unit: Column | str) -> Column:
    return numbers_in(unit)


def referrals(explained: DataFrame, report: str = "report_id") -> DataFrame:
    """report, n_tests, n_referred: different tests that need a GP, whether their text failed or nothing covers them."""
    marks = F.when(F.col("degraded"), F.col("test_id")).when(F.col("ungrounded"), F.col("raw_name"))
    return explained.groupBy(report).agg(F.count(F.lit(1)).alias("n_tests"), F.count_distinct(marks).alias("n_referred"))


def stubs(chunks: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """test_id, raw_name, specimen (none), unit of each id that the corpus covers and the cache lacks (all with ``force``)."""
    ids = covered_ids(chunks).withColumn("specimen", F.lit(None).cast("string"))
    todo = ids if force else cache_misses(ids, cache, ["test_id", "specimen"])
    return as_stubs(todo)


def as_stubs(ids: DataFrame) -> DataFrame:
    """Ids as tests without a reading."""
    return ids.withColumns({"specimen": F.lit(None).cast("string"), "raw_name": stub_name("test_id"), "unit": F.lit("")})


def verified_details(answers: DataFrame, tests: DataFrame) -> DataFrame:
    """test_id, specimen and the three fields of complete answers (slot and fields) each of whose fields its own test's
    context bears out, without any figure of its own."""
    rows = answers.join(tests.select("slot", "test_id", "specimen", "text"), "slot").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = rows.withColumns({"what_it_measures": strip("what_it_measures"), "gp_question": strip("gp_question"), "lifestyle_suggestions": F.filter(F.transform("lifestyle_suggestions", lambda x: strip(x)), lambda x: x != "")})
    rows = rows.where((F.col("what_it_measures") != "") & (F.col("gp_question") != "") & (F.size("lifestyle_suggestions") > 0))
    for said in (F.col("what_it_measures"), F.col("gp_question"), F.array_join("lifestyle_suggestions", " ")):
        rows = rows.where(grounded(said, "text")["ok"])
    return rows.select("test_id", "specimen", *FIELDS)


def verified_measures(answers: DataFrame, tests: DataFrame) -> DataFrame:
    """test_id, what_it_measures of answers whose text the test's context bears out."""
    rows = answers.join(tests.select("slot", "test_id", "text"), "slot").withColumn("what_it_measures", strip("what_it_measures"))
    return rows.where((F.col("what_it_measures") != "") & grounded("what_it_measures", "text")["ok"]).select("test_id", "what_it_measures")


__all__ = ["bundle", "generate", "in_waves", "explain", "judged", "new_entries", "shown", "parse_answers", "allowed_numbers", "offline_generator", "reassemble", "referrals", "stubs", "verified_details", "verified_measures"]
