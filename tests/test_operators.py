"""Extraction, selection, retrieval, explanation, corpora, streams and policy on small tables."""

import collections
import json
import os
import pathlib
import random
import re
import shutil
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from titrant.functions import text as X
from titrant.operators import corpus, dims, evaluate, explain, extract, results, retrieve, synonyms, verify
from titrant.plans import policy, reports
from titrant.sources import tables
from titrant.streaming import ingest


def alias(spark):
    return dims.aliases(spark, dims.reference(spark))


def test_text_rows(spark):
    lines = spark.createDataFrame([(1, 0, "--- PAGE 2 ---"), (1, 1, "Haemoglobin: 14.2 g/dL"), (1, 2, "HbA1c: 5.2 %"), (2, 0, "Platelets      250 10^9/L"), (2, 1, "| Platelets | 99 x |"), (2, 2, "ab")], "doc_id long, line_no long, line string")
    got = [(r["doc_id"], r["test_id"], r["value"], r["page"]) for r in extract.text_rows(lines, alias(spark)).orderBy("doc_id", "seq").collect()]
    assert got == [(1, "HGB", "14.2", 2), (1, "HBA1C", "5.2", 2), (2, "PLT", "250", 0)]


def test_dedupe_keeps_distinct_tubes(spark):
    names = ["TB NIL Tube", "TB Antigen Tube", "TB Mitogen Tube", "TB Ag Minus NIL", " tb nil tube "]
    rows = spark.createDataFrame([(k, n, "1 - 2" if k == 4 else None) for k, n in enumerate(names)], "seq long, raw_name string, ref_range string")
    got = results.dedupe(dims.resolve(rows, alias(spark))).collect()
    assert len(got) == 4 and {r["test_id"] for r in got} == {"TUBERCULOSIS"}
    assert {r["seq"] for r in got} == {1, 2, 3, 4}  # of the same name the row with a range stays


def test_finalise(spark):
    rows = spark.createDataFrame([("HGB", "11.6", None, None), ("HGB", "11.6", "12 - 15", None), ("ABO_TYPE", "A", None, "high"), ("X", "odd", None, "low"), (None, None, None, None)], "test_id string, value string, ref_range string, status string")
    got = [(r["status"], r["normal_range_min"]) for r in results.finalise(rows, dims.reference(spark), F.lit("female")).collect()]
    assert got == [("normal", 11.5), ("low", 12.0), ("normal", None), ("low", None), ("unknown", None)]


def test_upload_cascade(spark):
    lines = spark.createDataFrame([(1, 0, "Haemoglobin: 14.2 g/dL"), (2, 0, "Ferritin level was 44 on this day"), (3, 0, "nothing here")], "doc_id long, line_no long, line string")
    none_g = spark.createDataFrame([], tables.GRIDS)
    none_w = spark.createDataFrame([], tables.WORDS)
    seq = "seq struct<tier:int,page:int,a:bigint,b:bigint>"
    extracted = spark.createDataFrame([(2, (3, 1, 0, 0), "Ferritin", "44", "", None, "normal"), (2, (3, 1, 1, 0), "TSH", "2", "", None, None)], f"doc_id long, {seq}, raw_name string, value string, unit string, ref_range string, status string")
    got = {(r["doc_id"], r["test_id"], r["method"], r["status"]) for r in reports.upload(spark, none_g, none_w, lines, extracted).collect()}
    assert got == {(1, "HGB", "structured", "normal"), (2, "FERRITIN", "vision", "normal"), (3, "UNKNOWN_TEST", "manual_required", "unknown")}


PAGE = """<html><head><title>Creatinine Test: Site</title><script>var x = "<p>no</p>"</script></head><body><nav><p>menu</p></nav><div class="main">
<h2>What is it</h2><p>{body}</p><ul><li>First item</li></ul><h2>References</h2><p>{body}</p><h2>Short</h2><p>tiny</p><p>Copyright notice {body}</p>
<a href="https://medlineplus.gov/lab-tests/creatinine-test/">Creatinine Test (CRT)</a><a href="/x">y</a></div><footer><p>foot</p></footer></body></html>"""


def test_corpus(spark):
    body = "Creatinine is a waste product of muscles. " * 5
    pages = spark.createDataFrame([(1, PAGE.format(body=body)), (2, "<p>x"), (3, None)], "page_id long, html string")
    rows = corpus.sections(corpus.blocks(pages)).collect()
    assert [(r["title"], r["section"]) for r in rows] == [("Creatinine Test", "What is it")] and rows[0]["body"].endswith("First item")
    assert [(r["url"], r["ids"]) for r in corpus.discover(pages).collect()] == [("https://medlineplus.gov/lab-tests/creatinine-test/", ["CRT", "CREATININE"])]
    sources = spark.createDataFrame([(k, f"https://medlineplus.gov/{k}", "NIH", ["CREATININE"], k) for k in (1, 2, 3)], "page_id long, url string, source string, test_ids array<string>, seq long")
    made, failed = reports.build_corpus(pages, sources)
    assert made.count() == 1 and sorted(r[0] for r in failed.collect()) == [2, 3]
    with pytest.raises(ValueError, match="approved"):
        corpus.assert_inside(sources, "url", ("www.nhs.uk",))


def test_content_root_is_the_first_element_of_its_kind(spark):
    long = "Words about a test that are many enough. " * 4
    pages = {
        1: f"<article><h1>A</h1><p>{long}first</p></article><article><h2>B</h2><p>{long}second</p></article>",
        2: f"<body><main></main><article><p>{long}</p></article></body>",  # an empty main is the root
        3: f"<div class='x main'></div><main><p>{long}</p></main>",
        4: f"<header><main><h1>H</h1><form><p>gone</p></form><p>{long}kept</main></header><p>{long}</p>",  # stripped inside the root only
        5: f"<p>{long}one<p>two</p> three<ul><li>x<li>y</ul>",  # nothing but its end tag, or one around it, ends an element
        6: f"<article><p>{long}1&lt;2 a<b>b</b>c<!-- no --> d</p></article></div>",
        7: f"<title>T: x</title><svg><title>second</title></svg><body><p>{long}</body>",
    }
    frame = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    got = {r["page_id"]: r for r in corpus.sections(corpus.blocks(frame)).collect()}
    assert got[1]["section"] == "A" and got[1]["body"].endswith("first") and 2 not in got and 3 not in got
    assert got[4]["section"] == "H" and got[4]["body"].endswith("kept") and "gone" not in got[4]["body"]
    assert got[5]["body"] == f"{long}one two three x y two x y y"
    assert got[6]["body"].endswith("1<2 a b c d") and got[7]["title"] == "T"
    links = "<a href='https://medlineplus.gov/lab-tests/a/'><img></a><nav><a href='https://medlineplus.gov/lab-tests/b/'>B (BB) Test</a></nav><a href='https://medlineplus.gov/lab-tests/a/'>A</a>"
    assert [tuple(r) for r in corpus.discover(spark.createDataFrame([(1, links)], "page_id long, html string")).collect()] == [("https://medlineplus.gov/lab-tests/b/", ["BB", "B"])]


def test_corpus_files(spark, tmp_path):
    chunks = retrieve.embed(spark.createDataFrame([(1, "a b", "https://www.nhs.uk/x")], "id long, text string, url string"), "text")
    tables.write_corpus(chunks, f"{tmp_path}/c")
    tables.write_index_metadata(chunks, f"{tmp_path}/m", "terms")
    assert tables.read_corpus(spark, f"{tmp_path}/c").count() == 1
    assert spark.read.json(f"{tmp_path}/m").first()["chunk_count"] == 1
    schema = "k string, v string"
    cache = tables.read_cache(spark, f"{tmp_path}/none", schema)
    tables.merge_cache(cache, spark.createDataFrame([("a", "1"), (None, "2")], schema), ["k"], f"{tmp_path}/1")
    old = tables.read_cache(spark, f"{tmp_path}/1", schema)
    tables.merge_cache(old, spark.createDataFrame([(None, "3")], schema), ["k"], f"{tmp_path}/2")
    assert sorted((r["k"] or "", r["v"]) for r in spark.read.parquet(f"{tmp_path}/2").collect()) == [("", "3"), ("a", "1")]


def test_hybrid_needs_anchor_or_tag(spark):
    chunks = retrieve.embed(spark.createDataFrame([(1, ["CREATININE"], "Creatinine Test", "What", "about creatinine in blood"), (2, [], "Alkaline page", "What", "an enzyme")], "id long, test_ids array<string>, topic string, section string, text string"), "text")
    asked = spark.createDataFrame([(1, "Creatinine", "CREATININE"), (2, "pH", None), (3, "Zorblax", None)], "query_id long, name string, test_id string")
    got = retrieve.hybrid(retrieve.embed(asked, "name"), chunks).collect()
    assert [(r["query_id"], r["id"], r["rank"]) for r in got] == [(1, 1, 1)] and got[0]["tagged"]


def test_explain(spark):
    tests = spark.createDataFrame([(0, 1, "HGB", None, "Haemoglobin", "g/dL", "HGB"), (1, 1, "P2", None, "P2 Peak", "%", "P2"), (2, 1, "TSH", None, "TSH", "x", "TSH")], "slot long, report_id long, test_id string, specimen string, raw_name string, unit string, grounding_id string")
    ref = spark.createDataFrame([("HGB", "NHS", "Haemoglobin carries oxygen."), ("TSH", "NHS", "Thyroid hormone control.")], "test_id string, source string, plain_english string")
    passages = spark.createDataFrame([(0, 1, "Haemoglobin is red.", "NIH", "https://x"), (0, 2, " ", "NIH", "https://y")], "slot long, rank int, text string, source string, url string")
    cache = spark.createDataFrame([("TSH", None, "Thyroid from the cache", ["a", "b"], "Why thyroid?")], "test_id string, specimen string, what_it_measures string, lifestyle_suggestions array<string>, gp_question string")

    def wrong(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": batch["slot"], "what_it_measures": "Pancreas insulin 9.9", "lifestyle_suggestions": [["x"]] * len(batch), "gp_question": "q"})

    bundled = explain.bundle(tests, ref, passages)
    first = bundled.where("slot = 0").first()
    assert first["text"] == "(NHS) Haemoglobin carries oxygen.\n(NIH) Haemoglobin is red." and first["source_label"] == "NHS / NIH" and len(first["sources"]) == 1
    got = {r["slot"]: r for r in explain.explain(bundled, cache).collect()}
    assert (got[0]["degraded"], got[0]["ungrounded"]) == (False, False) and got[1]["ungrounded"] and got[2]["what_it_measures"] == "Thyroid from the cache"
    bad = {r["slot"]: r for r in explain.explain(bundled, cache, generator=wrong).collect()}
    assert bad[0]["degraded"] and bad[0]["what_it_measures"] == "Evaluates what Haemoglobin measures in the body." and not bad[2]["degraded"]
    assert bad[0]["source_label"] == explain.NOT_VERIFIED and bad[0]["sources"] == [] and got[0]["source_label"] == "NHS / NIH"
    assert bad[1]["source_label"] == explain.NOT_COVERED and bad[1]["what_it_measures"].startswith("NHS UK and NIH MedlinePlus reference material for P2 Peak was")
    assert tuple(explain.referrals(explain.explain(bundled, cache, generator=wrong)).first())[1:] == (3, 2)
    assert reports.summary(explain.explain(bundled, cache)).first()["n_tests"] == 3
    assert reports.evaluate_explanations(explain.explain(bundled, cache).withColumn("c", F.lit("all")), "c").count() == 2


def test_metrics_and_synonyms(spark):
    cases = spark.createDataFrame([(1, "A"), (2, "B")], "query_id long, expected string")
    found = spark.createDataFrame([(1, 1, ["A"]), (2, 1, ["A"]), (2, 2, ["B"])], "query_id long, rank int, tags array<string>")
    m = evaluate.retrieval_metrics(cases, found).first()
    assert (m["precision_at_1"], m["recall_at_k"], m["misses"]) == (0.5, 1.0, 0)
    assert evaluate.rejection_rate(spark.createDataFrame([(8,), (1,)], "query_id long"), found).first()["rejected"] == 0.5
    said = spark.createDataFrame([("a b", "X"), ("A-B", "X"), ("c", "X"), ("c", "Y"), ("d", "Z")], "alias string, test_id string")
    known = spark.createDataFrame([("d", "OTHER")], "alias_key string, test_id string")
    assert [tuple(r) for r in synonyms.accept(said, known).collect()] == [("a_b", "X")]


def test_reference_files(spark, tmp_path):
    rows = {"tests": [{"id": "HGB", "name": "Haemoglobin", "unit": "g/dL", "normal_range": {"male": {"min": 1, "max": 2}}}]}
    for k in (1, 2):
        (tmp_path / f"{k}.json").write_text(json.dumps(rows).replace('"max": 2', f'"max": {k + 4}'))
    got = dims.read_reference(spark, [f"{tmp_path}/1.json", f"{tmp_path}/2.json"]).collect()
    assert len(got) == 1 and (got[0]["male_max"], got[0]["default_max"]) == (6.0, 6.0)


def test_stream(spark, tmp_path):
    schema = "raw_name string, value string, unit string"
    spark.createDataFrame([("Hb", "10", "g/dL"), (" ", "1", "")], schema).write.parquet(f"{tmp_path}/in")
    q = ingest.run_finalise(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/cp", once=True)
    q.awaitTermination(60)
    assert [(r["test_id"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("HGB", "low")]
    fill = lambda rows: rows.select("raw_name", F.lit("text").alias("v"))
    q = ingest.run_cache_fill(spark, f"{tmp_path}/in", schema, ["raw_name"], fill, f"{tmp_path}/cache", "raw_name string, v string", f"{tmp_path}/cp2")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 2


def test_explain_asks_again_for_what_is_missing(spark, tmp_path):
    n, names = 9, "Alphin Betarol Gammose Deltide Epsilase Zetanol Etamine Thetane Iotase".split()
    tests = spark.createDataFrame([(k, 1, f"T{k}", None, names[k], "x", f"T{k}") for k in range(n)], "slot long, report_id long, test_id string, specimen string, raw_name string, unit string, grounding_id string")
    ref = spark.createDataFrame([(f"T{k}", "NHS", f"{names[k]} counts something here.") for k in range(n)], "test_id string, source string, plain_english string")
    none = spark.createDataFrame([], "slot long, rank int, text string, source string, url string")
    cache = spark.createDataFrame([], "test_id string, specimen string, what_it_measures string, lifestyle_suggestions array<string>, gp_question string")
    log, paused = str(tmp_path / "log"), []

    def model(name):
        def call(prompt, entry):
            ids = [line.split("|")[0].split(":")[1].strip() for line in prompt.split("\n") if line.startswith("- Test ID")]
            with open(log, "a") as f:
                f.write(f"{name} {' '.join(ids)}\n")
            if name == "down":
                raise ValueError("HTTP 503")
            told = [{"test_id": i, "what_it_measures": f"{names[int(i[1:])]} counts something.", "lifestyle_suggestions": ["Walk", "Sleep"], "gp_question": f"What about {names[3 if i == 'T2' else int(i[1:])]}?"} for i in ids]
            return json.dumps({"explanations": [t for t in told if t["test_id"] != "T8" and (t["test_id"] != "T4" or name == "spare")]})

        return call

    chain = policy.Chain({k: model(k) for k in ("down", "up", "spare")}, policy.Settings(text_chain=("down", "up"), reserved_chain=("spare:small",)), sleep=lambda s: None)
    bundled = explain.bundle(tests, ref, none)
    out = {r["slot"]: r for r in explain.explain(bundled, cache, generator=policy.generator(chain), pause=lambda: paused.append(1)).collect()}
    assert [k for k in out if out[k]["degraded"]] == [8] and paused == [1]
    assert out[4]["what_it_measures"] == "Epsilase counts something." and out[2]["gp_question"] == explain.ASK_INSTEAD and not out[2]["degraded"]
    asked = [line.split() for line in open(log).read().splitlines()]
    assert ["spare", "T4", "T8"] in asked and asked.count(["up", "T0", "T1", "T2", "T3", "T4", "T5"]) == 1 and ["up", "T8"] in asked[-2:]


def test_precompute(spark):
    chunks = retrieve.embed(spark.createDataFrame([(1, ["HGB", "TSH"], "Blood", "Hgb", "Hgb is a blood measure.", "u")], "id long, test_ids array<string>, topic string, section string, text string, url string"), "text")
    chunks = chunks.withColumn("source", F.lit("NIH"))
    ref = spark.createDataFrame([("HGB", "NHS", "Hgb carries oxygen.")], "test_id string, source string, plain_english string")
    cache = spark.createDataFrame([("TSH", None, "w", ["a"], "q")], "test_id string, specimen string, what_it_measures string, lifestyle_suggestions array<string>, gp_question string")
    made = reports.precompute(spark, ref, chunks, cache).collect()
    assert made == []  # the stand-in's advice is on no subject of the context
    short = reports.precompute(spark, ref, chunks, cache, measures_only=True).collect()
    assert [tuple(r) for r in short] == [("HGB", "Hgb carries oxygen.")]
    fine = lambda b: pd.DataFrame({"slot": b["slot"], "what_it_measures": "Hgb carries oxygen.", "lifestyle_suggestions": [["Oxygen walks "]] * len(b), "gp_question": "Why oxygen?"})
    made = reports.precompute(spark, ref, chunks, cache, fine, force=True).collect()
    assert [(r["test_id"], r["lifestyle_suggestions"]) for r in made if r["test_id"] == "HGB"] == [("HGB", ["Oxygen walks"])]
    assert [r["raw_name"] for r in explain.stubs(chunks.withColumn("test_ids", F.array(F.lit("90_DAY_B12_2H"))), cache).collect()] == ["90 Day B12 2H"]


def test_synonym_flow(spark):
    chunks = spark.createDataFrame([(["A"], "one"), (["A", "B"], "two")], "test_ids array<string>, topic string")
    asked = spark.createDataFrame([("A", "Alpha")], "test_id string, alias string")
    propose = lambda todo: todo.select("test_id", F.explode(F.array(F.lit("Beta"), F.lit("alpha"), F.lit("Known"), F.lit("-"))).alias("alias"))
    every, judged = reports.generate_synonyms(chunks, asked, spark.createDataFrame([("known", "Z")], "alias_key string, test_id string"), propose)
    assert every.count() == 5 and {(r["alias_key"], r["verdict"]) for r in judged.collect()} == {("alpha", "ambiguous"), ("beta", "accepted"), ("known", "collision")}
    assert [r["alias_key"] for r in synonyms.rejected(judged).collect()] == ["alpha", "known"]


def test_caches_and_alias_files(spark, tmp_path):
    schema, path = "k string, v string", f"{tmp_path}/cache"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert tables.save_cache(spark, rows(("a", "1"), (None, "2")), ["k"], path, schema)
    assert tables.save_cache(spark, rows(("a", "3"), ("b", "4")), ["k"], path, schema)
    assert sorted(map(tuple, tables.read_cache(spark, path, schema).collect()), key=str) == [("a", "3"), ("b", "4"), (None, "2")]
    assert [p.name for p in tmp_path.iterdir()] == ["cache"]
    (tmp_path / "file").write_text("x")
    assert not tables.save_cache(spark, rows(("a", "1")), ["k"], f"{tmp_path}/file/cache", schema)
    for text, found in (('{"a b": "X", "c": null}', [("a b", "X")]), ("[1", []), ("", [])):
        (tmp_path / "aliases.json").write_text(text)
        assert [tuple(r) for r in tables.read_aliases(spark, f"{tmp_path}/aliases.json").collect()] == found
    assert tables.read_aliases(spark, f"{tmp_path}/none.json").count() == 0
    typed = spark.createDataFrame([(1, "Hb", 1.0), (2, "TSH", 2.0), (3, " hb ", 3.0), (4, "", 4.0)], "n long, raw_name string, value double")
    assert sorted((r["first_seq"], r["raw_name"], r["value"]) for r in results.upsert_entries(typed, "raw_name", "n").collect()) == [(1, " hb ", 3.0), (2, "TSH", 2.0)]
    tables.write_evaluation(rows(("a", "1")), rows(("all", "1")), f"{tmp_path}/eval")
    assert spark.read.option("header", True).csv(f"{tmp_path}/eval/rows").count() == spark.read.json(f"{tmp_path}/eval/summary").count() == 1


def test_header_tables_and_ruled_pages(spark):
    head, body = ["Test Name", "Result", "Unit", "Ref Range"], ["Hb", "12", "g/dL", "11 - 16"]
    grids = spark.createDataFrame([
        (1, 1, 0, 0, head), (1, 1, 1, 0, body),  # glued
        (2, 1, 0, 0, head),  # alone: no grid
        (3, 1, 0, 0, head), (3, 1, 1, 0, head), (3, 1, 2, 0, body),  # the first is put before the second, the third has none
        (4, 1, 0, 0, head), (4, 1, 1, 0, head), (4, 1, 2, 0, head), (4, 1, 3, 0, body),
    ], "doc_id long, page int, table_no int, row_no int, cells array<string>")
    glued = extract.glue_header_tables(grids)
    assert {r["doc_id"] for r in glued.collect()} == {1, 3, 4}
    assert sorted(r["doc_id"] for r in extract.grid_rows(glued).collect()) == [1, 4]
    place = lambda text, x, top: (text, float(x), float(x + 20), float(top))
    cells = [place(*w) for w in (("Investigation", 10, 0), ("Result", 200, 0), ("Unit", 300, 0), ("Hb", 10, 10), ("12", 200, 10), ("g/dL", 300, 10))]
    words = spark.createDataFrame([(d, 1, t, x, y, top, True, 600.0) for d in (1, 2) for t, x, y, top in cells], tables.WORDS)
    pages = spark.createDataFrame([(2, 1, "x Specimen: Urine routine"), (1, 1, "y")], "doc_id long, page int, text string")
    rows = extract.structured_tables(grids, words, pages, dims.aliases(spark, dims.reference(spark))).collect()
    assert sorted((r["doc_id"], r["test_id"], r["ref_range"]) for r in rows) == [(1, "HGB", "11 - 16"), (2, "HGB", None), (4, "HGB", "11 - 16")]


def test_cascade_modes(spark):
    row = "doc_id long, seq struct<tier:int,a:int>, raw_name string, value string, ref_range string, test_id string, known boolean"
    rows = lambda *r: spark.createDataFrame([(d, (t, k), f"n{k}", "1", None, f"T{k}", True) for d, t, k in r], row)
    table_rows, extracted, text = rows(*[(1, 0, k) for k in range(3)], (2, 0, 1), (5, 0, 1), (6, 0, 1)), rows((2, 1, 2), (3, 1, 1)), rows((2, 2, 3), (4, 2, 1), (5, 2, 2), (6, 2, 2))
    docs = spark.createDataFrame([(1, False, None), (2, True, "vision"), (3, False, "llm_text"), (4, True, None), (5, False, "vision"), (6, True, None), (7, False, "vision")], "doc_id long, ocr boolean, tier string")
    got = lambda mode: {d: (m, n) for d, m, n in extract.cascade(table_rows, extracted, text, docs, mode).groupBy("doc_id", "method").agg(F.count("raw_name")).collect()}
    assert got("auto") == {1: ("table_structured", 3), 2: ("ocr_vision", 2), 3: ("llm_text", 1), 4: ("ocr_structured", 1), 5: ("vision", 1), 6: ("ocr_structured", 2), 7: ("manual_required", 0)}
    assert got("regex") == {1: ("manual_required", 0), 2: ("ocr_structured", 1), 3: ("manual_required", 0), 4: ("ocr_structured", 1), 5: ("structured", 1), 6: ("ocr_structured", 1), 7: ("manual_required", 0)}
    layers = spark.createDataFrame([("x" * 40, "read"), ("short", "read"), ("short", " "), (None, None)], "layer string, read string")
    said = lambda mode: [tuple(r["t"]) for r in layers.select(extract.report_text("layer", "read", mode).alias("t")).collect()]
    assert said("auto") == [("x" * 40, False), ("read", True), ("short", False), ("", False)] and said("ocr")[0] == ("read", True)


def test_source_verification_reads_the_value_on_the_same_line(spark):
    claims = spark.createDataFrame([(1, 1, "Serum Creatinine Level", "1.2"), (1, 2, "Serum Creatinine Level", "7"), (1, 3, "Ferritin", ""), (2, 4, "Ferritin", "3")], "doc_id long, claim_id long, raw_name string, value string")
    texts = spark.createDataFrame([(1, "Creatinine Serum 1.2 mg\nFerritin 17\n7 apart"), (2, None)], "doc_id long, text string")
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    for sources, how in ((texts, {}), (lines, {"text": "line", "line_no": "line_no"})):
        assert sorted(r["claim_id"] for r in verify.keep_verified(claims, sources, **how).collect()) == [1, 3]


def test_top_k_in_parts_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(60, 4)), 1)
    vectors[10:20] = vectors[0]
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(99, None)], "id long, embedding array<float>").repartition(3)
    queries = chunks.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    score = np.round(vectors.astype(np.float32).astype(float) @ vectors.astype(np.float32).astype(float).T, 12)
    want = {(q, n + 1): k for q in range(0, 60, 7) for n, k in enumerate(sorted(range(60), key=lambda k: (-score[q, k], k))[:5])}
    for name, value in ((None, 0), ("PART", 7), ("QUERIES", 2), ("ASKED", 2), ("ROWS", 3)):
        if name:
            monkeypatch.setattr(retrieve, name, value)
        assert {(r["query_id"], r["rank"]): r["id"] for r in retrieve.top_k(chunks, queries, 5).collect()} == want
    assert retrieve.top_k(chunks, queries.where("false"), 5).count() == retrieve.top_k(chunks.where("false"), queries, 5).count() == 0
    groups = rng.normal(size=(6, 16)) * 9
    near = np.vstack([g + rng.normal(size=(40, 16)) * 0.1 for g in groups] + [np.zeros((1, 16))]).astype(np.float32)
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(near)], "id long, embedding array<float>")
    monkeypatch.setattr(retrieve, "PART", 12)
    visits = []
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieve.top_k(chunks, chunks.withColumnRenamed("id", "query_id"), 3, visits=visits).collect()}
    score = np.round(near.astype(float) @ near.astype(float).T, 12)
    assert got == {(q, n + 1): k for q in range(241) for n, k in enumerate(sorted(range(241), key=lambda k: (-score[q, k], k))[:3])}
    assert visits[0].where("q < 240").agg(F.avg("parts")).first()[0] < 10  # of 21
    tagged = spark.createDataFrame([(["B", "A"],), (["A"],)], "test_ids array<string>")
    assert [r["test_id"] for r in retrieve.covered_ids(tagged).collect()] == ["A", "B"]


def test_chain():
    now, calls, waits = [0.0], [], []

    def fails(reason):
        def call(prompt, model):
            calls.append((reason, model))
            raise ValueError(reason)

        return call

    well = lambda prompt, model: f"{prompt} {model}"
    settings = policy.Settings(text_chain=("a", "b:x", "b:y", "c", "d"), reserved_chain=("r:1",), vision_chain=("c", "a"))
    chain = policy.Chain({"a": fails("HTTP 429, try again in 7.5s"), "b": fails("timeout"), "c": well, "d": well, "r": well}, settings, frozenset({"c"}), frozenset({"d"}), lambda: now[0], waits.append)
    assert chain.call("hi") == "hi None" and [c[1] for c in calls] == [None, None, "x", "x", "y", "y"] and waits == [1.5] * 3
    assert chain.order() == ["c"] and chain.shut == {"a": 8.5, "b:x": 60.0, "b:y": 60.0}  # the provider as a whole, then single models
    now[0] = 9
    assert chain.order(1) == ["c", "a"] and chain.order(reserve=True) == ["r:1", "a", "c"] and chain.order(capability="vision") == ["c"]
    assert chain.call("again", reserve=True) == "again 1"
    only = policy.Chain({"a": fails("404 not found")}, policy.Settings(text_chain=("a",)), clock=lambda: 0.0, sleep=waits.append)
    for _ in range(2):  # benched, but there is no one else
        with pytest.raises(policy.Unavailable):
            only.call("x")
    assert len(waits) == 3 and calls[-2:] == [("404 not found", None)] * 2
    with pytest.raises(policy.Unavailable):
        policy.Chain({}).call("x")
    read = policy.Settings.read({"TEXT_FALLBACK_CHAIN": "a, b:x,", "LLM_MAX_RETRIES": "4"})
    assert (read.text_chain, read.retries, read.cooldown) == (("a", "b:x"), 4, 60.0)


def test_the_rest_stands_alone(tmp_path):
    root = pathlib.Path(__file__).resolve().parents[1]
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git")
    for name in ("titrant", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=skip)
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = lambda *a: subprocess.run([sys.executable, "-B", *a], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    told = run("-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))")
    assert told.stdout.split()[1:] == ["True", "False"] and int(told.stdout.split()[0]) > 60, told.stderr
    (tmp_path / "titrant" / "llm").mkdir()  # there, but something it needs is not
    (tmp_path / "titrant" / "llm" / "__init__.py").write_text("import a_module_that_is_not_there\n")
    (tmp_path / "corpus_pipeline.py").write_text("from titrant import llm\n")
    assert run("-c", "import __spark_entry__ as e; print(len(e.queries()))").stdout == told.stdout.split()[0] + "\n"
    collected = run("-m", "pytest", "--collect-only", "-q", "tests", "-p", "no:cacheprovider")
    assert collected.returncode == 0 and "error" not in collected.stdout.lower(), collected.stdout


def test_unsourced_and_reviewed_rows(spark):
    rows = spark.createDataFrame([(" Hb ", " 12 ", None, " 11 - 12 ", "HIGH"), ("", "1", "u", "", None), ("TSH", " ", "u", "", None)], "raw_name string, value string, unit string, ref_range string, status string")
    got = extract.clean_extracted(rows, alias(spark)).collect()
    assert [(r["raw_name"], r["value"], r["unit"], r["ref_range"], r["status"], r["test_id"], r["needs_review"]) for r in got] == [("Hb", "12", "", "11 - 12", "high", "HGB", True)]


def test_claims_are_looked_up_by_their_rarest_words(spark):
    lines = [(1, k, f"Serum common thing {k} rareword{k % 3} {k}.5") for k in range(40)]
    sources = spark.createDataFrame(lines, "doc_id long, line_no long, line string")
    claims = spark.createDataFrame([(1, k, f"Common thing rareword{k} serum", f"{k}.5") for k in range(3)] + [(1, 9, "Common serum", "7.5"), (1, 10, "common absent missing", "1"), (1, 11, "Thing thing rareword1", None)], "doc_id long, claim_id long, raw_name string, value string")
    words = verify._lines(sources, "doc_id", "line", "line_no").select("_d", "_n", F.explode(F.array_distinct(F.split(X.match_form("_line"), " "))).alias("_w"))
    by = {}
    for r in verify.looked_up(claims, words, "doc_id", "claim_id", "raw_name", "value").collect():
        by.setdefault(r["claim_id"], set()).add(r["_word"])
    assert all(f"rareword{k}" in by[k] and len(by[k]) == 2 for k in range(3)) and len(by[9]) == 1 and {"absent", "missing"} == by[10]
    got = sorted(r["claim_id"] for r in verify.keep_verified(claims, sources, text="line", line_no="line_no").collect())
    assert got == [0, 1, 2, 9, 11]
    twice = claims.unionByName(claims)
    assert verify.keep_verified(twice, sources, text="line", line_no="line_no").count() == 10


def test_only_lines_that_may_bear_out_a_claim_are_kept(spark):
    r = random.Random(4)
    word = lambda: r.choice(["alpha", "Beta", "gamma2", "(delta)", "eps-ilon", "zeta,", "of", "report", "É7"])
    text = {d: "\n".join(" ".join(word() for _ in range(r.randrange(9))) + f" {r.randrange(4)}.5" for _ in range(12)) for d in range(12)}
    asked = [(d, k, " ".join(word() for _ in range(r.randrange(6))), r.choice(["1.5", "", None, "3.5 g"])) for d in range(10) for k in range(6)] + [(0, 6, "alpha alpha alpha beta", "")]
    claims = spark.createDataFrame(asked, "doc_id long, claim_id long, raw_name string, value string")
    sources = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    words = lambda line: [w for w in re.sub(r"[^a-z0-9\s]", " ", re.sub(r"\(.*?\)", "", line).lower()).split() if w]
    mine, want, likely = collections.defaultdict(set), set(), set()
    for d, k, name, value in asked:
        every = words(name)
        plain = [w for w in every if w not in X.STRUCTURAL_WORDS]
        mine[d, k] = [w for w in plain if len(w) > 2] or plain or every
        digits = re.sub(r"[^\d.]", "", value or "")
        for n, line in enumerate(text[d].split("\n")):
            if mine[d, k] and sum(w in words(line) for w in mine[d, k]) / len(mine[d, k]) >= 0.6:
                likely.add((d, n))
                if not digits or re.search(rf"(?<!\d){re.escape(digits)}(?!\d)", line):
                    want.add((d, k))
    found = verify.likely_lines(verify._asked(claims, "doc_id", "claim_id", "raw_name", "value"), sources).collect()
    assert likely <= {(x["_d"], x["_n"]) for x in found} and len(found) < 10 * 12
    for x in found:
        asks = [mine[d, k] for d, k in mine if d == x["_d"] and mine[d, k]]
        assert set(x["_has"]) == set(words(x["_line"])) & {w for ws in asks for w in ws}
        assert len(x["_has"]) >= min(max(1, -(-len(ws) * 6 // 10) - len(ws) + len(set(ws))) for ws in asks)
    assert {(x["doc_id"], x["claim_id"]) for x in verify.keep_verified(claims, sources).collect()} == want and len(want) > 10


def oracle(folder, name):
    import duckdb

    from titrant import catalogue

    db = duckdb.connect()
    for f in folder.glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    return sorted(db.execute(catalogue.ORACLES[name]).fetchall())


@pytest.mark.parametrize("name", ["html_sections", "corpus_chunks"])
def test_character_references_without_a_semicolon(spark, tmp_path, name):
    """A heading cut inside a reference: the SQL reads references that a semicolon ends, a browser the others, too."""
    from titrant import catalogue

    html = "<html><head><title>And&amp;&amp;{0}</title></head><body><article><h1>And&amp;&amp;{0}</h1><p>" + "Fish &amp; chips &quot;here&quot; &am and more. " * 5 + "</p></article></body></html>"
    pages = [(4 * k, f"https://x/{k}", html.format(cut)) for k, cut in enumerate(("&amp", "&quot", "&amp;"))]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    assert sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect())) == oracle(tmp_path, name)
    heads = corpus.blocks(spark.createDataFrame(pages, "page_id long, url string, html string"), tags=("h1",))
    assert [r["text"] for r in heads.orderBy("page_id").collect()] == ["And&&&", 'And&&"', "And&&&"]


def test_chunks_are_shuffled_without_their_sections(spark):
    """Sections are made where pages are read, and what meets by its beginning is the chunk, not the section's whole text too."""
    body = " ".join(f"Sentence number {k} of a page that goes on." for k in range(200))
    pages = [(k, f"https://x/{k}", f"<title>T{k}</title><article><p>{k} before</p><h1>A{k}</h1><p>{k} {body}</p><h2>B</h2><h2>C</h2><p>{body}</p></article>") for k in (1, 2, None)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = corpus.page_sections(pages, more=("url",))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.drop("url").collect())) == sorted(map(tuple, corpus.sections(corpus.blocks(pages.where("page_id is not null"))).collect()))
    made = corpus.chunks(got.withColumns({"source": F.lit("s"), "test_ids": F.array(F.lit("x")), "seq": F.col("page_id")}))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Aggregate" in line and "body" in line]
    sources = spark.createDataFrame([(k, f"https://x/{k}", "s", ["x"], k) for k in (1, 2)], "page_id long, url string, source string, test_ids array<string>, seq long")
    again = corpus.chunks(corpus.sections(corpus.blocks(pages)), sources)
    rows = sorted(map(str, made.collect()))
    assert rows == sorted(map(str, again.collect())) and len(rows) == 10


def test_boilerplate_is_looked_for_by_its_words(spark):
    words = corpus.BOILERPLATE[5:-1].replace("\\.", ".").split("|")
    assert sorted(words) == sorted(corpus.BOILERPLATE_HAS)
    said = [f"x {w.title()} y" for w in words] + [w.upper() for w in words] + ["adam", "Copy right", "", "İ page", "java script"]
    got = spark.createDataFrame([(w,) for w in said], "t string").select(corpus._boilerplate(F.col("t")).alias("a"), F.col("t").rlike(corpus.BOILERPLATE).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [True] * 2 * len(words) + [False] * 5


def test_pages_are_read_few_at_a_time(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 10_000)
    try:
        pages = spark.range(1200).selectExpr("id as page_id", "'<body><h1>a</h1><p>b</p><h2> c</h2></body>' as html").coalesce(1)
        found = corpus.blocks(pages, tags=("h1", "h2", "h3"))
        assert int(spark.conf.get(key)) <= 500
        assert found.count() == 2400 and found.where("tag = 'p'").count() == 0
    finally:
        spark.conf.set(key, before)


def test_header_columns_are_worked_out_once(spark):
    """The plan reads each step of a line once: no filter of accepted rows has moved before the columns that it reads."""
    grids = spark.createDataFrame([(1, 1, 0, 0, ["Test Name", "Result"]), (1, 1, 1, 0, ["Hb", "H 12"]), (1, 1, 1, 1, ["x", ""])], "doc_id long, page int, table_no int, row_no int, cells array<string>")
    found = extract.grid_rows(extract.glue_header_tables(grids))
    assert [(r["raw_name"], r["value"], r["flag"]) for r in found.collect()] == [("Hb", "12", "H")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and not [line for line in plan.split("\n") if "Filter" in line and "RLIKE" in line]
    stripped = spark.range(1).select(X.strip(F.lit(" \t\n\x0b\f\r a b \n")), X.strip(F.lit("-* a•\t"), r" \-*•\t"), X.strip_footer(F.lit("1 - 2 END OF REPORT x")))
    assert tuple(stripped.first()) == ("a b", "a", "1 - 2")
