"""Extraction by generator: batches of page images, failures kept apart, the text tier behind them."""

import base64
import json

import pytest

from titrant.operators import dims, vision
from titrant.plans import policy, reports


def readers():
    """Readers of page images and texts that hold lines of raw_name|value|...; made here so that they travel by value."""
    fields, begins = vision.FIELDS, vision.TEXT_ASKED[0]

    def answer(lines):
        if "bad" in lines:
            raise ValueError("unreadable page")
        if "chat" in lines:
            return "I see no results."
        return "```json\n" + json.dumps({"results": [dict(zip(fields, line.split("|"), strict=False)) for line in lines if line]}) + "\n```"

    def see(text, images):
        return answer([line for i in images for line in base64.b64decode(i.split(",", 1)[1]).decode().split("\n")])

    def told(text, images):
        assert not images and text.startswith(begins)
        return answer(text.split("\n")[2:-1])

    return see, told


see, told = readers()


def test_batches_and_failures(spark):
    pages = [(1, k, f"Marker {k}|{k}.5|g|1 - {k}.5|HIGH ".encode()) for k in range(1, 20)]
    pages[5] = (1, 6, b"bad")
    pages[18] = (1, 19, "Marker 2 |7|g||\nmarker 2|2.5|g|\n|3\nNo value||".encode())
    pages += [(2, 1, b"chat"), (3, 1, b"bad"), (4, 2, None), (4, 9, b"HbA1c|5.7|%|4 - 6|"), (5, 1, b"")]
    frame = spark.createDataFrame(pages, "doc_id long, page int, image binary").repartition(4)
    batches = {(r["doc_id"], r["page_range"]): len(r["images"]) for r in vision.page_batches(frame).collect()}
    assert batches == {(1, "1-4"): 4, (1, "5-8"): 4, (1, "9-12"): 4, (1, "13-16"): 4, (1, "17-19"): 3, (2, "1-1"): 1, (3, "1-1"): 1, (4, "1-1"): 1, (5, "1-1"): 1}
    alias = dims.aliases(spark, dims.reference(spark))
    read = vision.read_images(vision.page_batches(frame), see, at_once=3)
    calls = {(r["doc_id"], r["page_range"]): (r["ok"], r["n_results"], r["failure"]) for r in vision.outcomes(read).collect()}
    assert calls[1, "5-8"] == (False, 0, "ValueError: unreadable page") and calls[2, "1-1"] == (False, 0, "no results in the answer")
    assert calls[1, "17-19"] == (True, 6, None) and calls[5, "1-1"] == (True, 0, None)
    rows = vision.extracted(read, alias).orderBy("doc_id", "seq").collect()
    one = [r for r in rows if r["doc_id"] == 1]
    assert [(r["raw_name"], r["page_range"]) for r in one] == [(f"Marker {k}", f"{(k - 1) // 4 * 4 + 1}-{min(19, (k - 1) // 4 * 4 + 4)}") for k in range(1, 19) if not 5 <= k <= 8]
    assert all(r["needs_review"] and r["status"] == "high" for r in one)
    assert [(r["test_id"], r["needs_review"]) for r in rows if r["doc_id"] == 4] == [("HBA1C", False)]


def test_outcomes_stay_by_report_and_are_read_once(spark):
    """What follows the calls starts where a report's outcomes lie, without a shuffle or the answers; an answer that is no text
    fails alone; images beyond a batch's bytes are handed on."""

    def odd(text, images):
        said = base64.b64decode(images[0].split(",", 1)[1])
        return {"results": []} if said == b"dict" else "\ud800" if said == b"cut" else see(text, images) if len(said) < 99 else '{"results": [{"raw_name": "Big", "value": "%d"}]}' % len(said)

    pages = [(1, 1, b"dict"), (2, 1, b"cut"), (3, 1, b"Alpha|3|g")] + [(4, k, bytes(vision.BYTES // 4 + k)) for k in range(1, 14)]
    pages = spark.createDataFrame(pages, "doc_id long, page int, image binary").repartition(2)
    read = vision.read_images(vision.page_batches(pages), odd)
    assert "answer" not in read.columns
    calls = {(r["doc_id"], r["page_range"]): (r["ok"], r["n_results"]) for r in vision.outcomes(read).collect()}
    assert calls == {(1, "1-1"): (False, 0), (2, "1-1"): (False, 0), (3, "1-1"): (True, 1)} | {(4, r): (True, 1) for r in ("1-4", "5-8", "9-12", "13-13")}
    found = vision.extracted(read, dims.aliases(spark))
    assert "hashpartitioning(doc_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["value"] for r in found.where("doc_id = 4").collect()] == [str(vision.BYTES // 4 + 1)]


def test_text_is_read_where_no_image_was(spark):
    pages = spark.createDataFrame([(1, 1, b"Alpha|3|g"), (2, 1, b"bad"), (3, 1, b"bad")], "doc_id long, page int, image binary")
    texts = spark.createDataFrame([(1, "Beta|4|g"), (2, "Gamma|5|g\nGamma|6|g"), (3, " \n"), (4, "chat"), (5, "Delta|1|g")], "doc_id long, text string")
    rows, tiers, calls = vision.holistic(pages, texts, dims.aliases(spark), see, told)
    assert {(r["doc_id"], r["tier"], r["raw_name"], r["value"]) for r in rows.collect()} == {(1, "vision", "Alpha", "3"), (2, "llm_text", "Gamma", "5"), (5, "llm_text", "Delta", "1")}
    assert {r["doc_id"]: r["tier"] for r in tiers.collect()} == {1: "vision", 2: "llm_text", 3: "failed", 4: "failed", 5: "llm_text"}
    assert sorted((r["doc_id"], r["tier"], r["ok"]) for r in calls.collect()) == [(1, "vision", True), (2, "llm_text", True), (2, "vision", False), (3, "vision", False), (4, "llm_text", False), (5, "llm_text", True)]
    none = vision.holistic(pages.where("false"), texts.where("false"), dims.aliases(spark), see, told)
    assert [f.count() for f in none] == [0, 0, 0]


def test_report_read_by_its_pages(spark):
    lines = spark.createDataFrame([(1, 1, "Glucose 5 mmol/L measured"), (1, 2, "Ferritin 88 ug/L measured"), (2, 1, "nothing here")], "doc_id long, line_no long, line string")
    grids = spark.createDataFrame([], "doc_id long, page int, table_no int, row_no int, cells array<string>")
    words = spark.createDataFrame([], "doc_id long, page int, text string, x0 double, x1 double, top double, upright boolean, page_width double")
    pages = spark.createDataFrame([(1, 1, b"Ferritin|88|ug/L|10 - 100|\nInvented|4|g||"), (2, 1, b"bad")], "doc_id long, page int, image binary")
    rows, calls = reports.read_and_upload(spark, grids, words, lines, pages, see, told)
    got = {(r["doc_id"], r["raw_name"]): r for r in rows.collect()}
    assert got[1, "Ferritin"]["method"] == "vision" and got[1, "Ferritin"]["status"] == "normal" and (1, "Invented") not in got
    assert [r["method"] for k, r in got.items() if k[0] == 2] == ["manual_required"]
    assert calls.where("not ok").count() >= 1


def test_reader_of_a_chain():
    asked = []

    def provider(prompt, model):
        asked.append(prompt)
        return "{}"

    chain = policy.Chain({"eye": provider, "ear": provider}, policy.Settings(text_chain=("ear",), vision_chain=("ear", "eye")), vision=frozenset({"eye"}))
    assert policy.reader(chain)("look", ["data:image/png;base64,AA=="]) == "{}"
    assert [b["type"] for b in json.loads(asked[0])] == ["text", "image_url"]
    assert policy.reader(chain, "text")("read", []) == "{}" and asked[1] == "read"
    with pytest.raises(policy.Unavailable):
        policy.reader(policy.Chain({"ear": provider}, policy.Settings(vision_chain=("ear",))))("look", [])
