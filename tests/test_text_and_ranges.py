"""Names, values, numbers, ranges and statuses: the reference cases as data."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from titrant.functions import ranges as R
from titrant.functions import text as X
from titrant.operators import corpus, dims, extract, verify
from titrant.operators.corpus import split_long


def each(spark, column, values, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_resolve(spark):
    cases = {
        "Hb": "HGB", "HbA1c": "HBA1C", "White Blood Cell Count": "WBC", "Total Cholesterol": "CHOL", "LDL Cholesterol": "LDL", "Vitamin D": "VIT_D",
        "Vitamin B12": "B12", "Blood Glucose": "GLUCOSE", "Urine Protein": "URINE_PROTEIN", "Creatinine, Serum": "CREATININE", "Glucose (Plasma)": "GLUCOSE",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [("nonsense_test",)], "raw_name string")
    got = {r["raw_name"]: (r["test_id"], r["known"]) for r in dims.resolve(rows, dims.aliases(spark, dims.reference(spark))).collect()}
    assert got == {k: (v, True) for k, v in cases.items()} | {"nonsense_test": ("NONSENSE_TEST", False)}


def test_canonical_name(spark):
    cases = [("Urinary RBC", "URINARY_RBC"), ("RBC", "RBC"), ("Blood [In Urine]", "BLOOD"), ("", "UNKNOWN_TEST"), ("Creatinine (24 hours)", "CREATININE")]
    assert each(spark, X.canonical_name("x"), [c for c, _ in cases]) == [e for _, e in cases]


def test_flags_and_furniture(spark):
    assert [tuple(v) for v in each(spark, X.split_name_flag("x"), ["HbA1c H", "Urea L", "Creatinine, Serum"])] == [("HbA1c", "H"), ("Urea", "L"), ("Creatinine, Serum", None)]
    assert [tuple(v) for v in each(spark, X.clean_value("x"), ["H 141.0", "H10570", "Present (+)", "12"])] == [("141.0", "H"), ("10570", "H"), ("Present", None), ("12", None)]
    assert each(spark, X.strip_footer("x"), ["0 - 14 Dr.Sam MD Path Page 1 of 19", "74 - 106 Page 4 of 19 # Referred Test", "13.0 - 16.5"]) == ["0 - 14", "74 - 106", "13.0 - 16.5"]
    assert each(spark, X.is_test_name("x"), ["Dr. Sam", "MD(Path)", "", "Haemoglobin", "Total Iron Binding Capacity (TIBC)"]) == [False, False, False, True, True]
    assert each(spark, X.unglue_name("x"), ["x\nHaemoglobin", "Haemoglobin\nmore text", "plain"]) == ["Haemoglobin", "Haemoglobin\nmore text", "plain"]
    assert [tuple(v) for v in each(spark, X.split_unit_range("x", F.lit("r")), ["% 40 - 80", "g/dL"])] == [("%", "40 - 80"), ("g/dL", "r")]
    assert each(spark, X.is_result_value("x", F.lit("ABO Type")), ['"A"', "1-2", "12.", "", "Nil", "words here"]) == [True, True, True, False, True, False]


@pytest.mark.parametrize(
    ("printed", "bounds"),
    [
        ("11.5 - 17.5", (11.5, 17.5)), ("5.7% - 6.4%", (5.7, 6.4)), ("< 16.7", (None, 16.7)), ("≥ 40", (40.0, None)), ("6 .0 - 8.0 pH", (6.0, 8.0)),
        ("Desirable: < 200 Borderline: 200 - 239 High: > 240", (None, 200.0)), ("Low: < 40 High: > 60", (40.0, None)),
        ("Deficiency: < 20 Insufficiency: 20 - 29 Sufficiency: 30 - 100", (30.0, 100.0)), ("Negative", None), ("", None), (None, None),
    ],
)
def test_parse_range(spark, printed, bounds):
    got = each(spark, R.parse_range("x"), [printed])[0]
    assert (got and tuple(got)) == bounds


def test_status(spark):
    none = F.lit(None).cast(R.BOUNDS)
    column = R.status("x", none, F.lit(11.5), F.lit(17.5), F.lit(None).cast("string"))
    assert each(spark, column, ["10.0", "14.0", "20.0", "NaN", "Negative", "3+", "odd", None]) == ["low", "normal", "high", "unknown", "normal", "high", "unknown", "unknown"]
    assert each(spark, R.on_boundary("x", F.lit("5.7 - 6.4")), ["5.7", "7.1"]) == [True, False]


def test_numbers(spark):
    cases = {"omega-3": [], "COVID-19": [], "6-8 glasses": [6, 8], "10^9/L": [10, 9], "150,000": [150000], "T3 and B12": []}
    assert each(spark, X.numbers_in("x"), list(cases)) == list(cases.values())
    assert each(spark, X.lifestyle_numbers_in("x"), ["6-8 glasses", "150 minutes", "5 mg"]) == [[6, 8], [150], []]


def test_grounded(spark):
    def check(generated, context, *allowed):
        column = verify.grounded(F.lit(generated), F.lit(context), F.array(*map(F.lit, map(float, allowed))) if allowed else None)
        return spark.range(1).select(column).first()[0]

    assert check("", "x")["reason"] == "empty explanation"
    assert not check("A haemoglobin below 7.3 is 325 mg", "haemoglobin carries oxygen")["ok"]
    assert "7.3, 325" in check("A haemoglobin below 7.3 is 325 mg", "haemoglobin carries oxygen")["reason"]
    assert "overlap" in check("pancreas releases insulin", "haemoglobin carries oxygen")["reason"]
    assert check("haemoglobin of 73 and 40", "haemoglobin", 73, 40)["ok"]
    assert check("haemoglobin needs 150 minutes", "haemoglobin")["ok"]
    assert check("platelets 150,000", "platelets", 150000)["ok"]


def test_other_test_named(spark):
    column = verify.other_test_named(F.lit("What does ferritin mean?"), F.lit("Haemoglobin"), F.array(F.lit("Vitamin Level"), F.lit("Ferritin")))
    assert spark.range(1).select(column).first()[0] == "Ferritin"


def test_source_verification(spark):
    sources = spark.createDataFrame([(1, "Haemoglobin (Hb) 14.2 g/dL\nCount 44109"), (2, "")], "doc_id long, text string")
    claims = spark.createDataFrame([(1, 1, "Haemoglobin", "14.2"), (1, 2, "Haemoglobin", "4.2"), (1, 3, "Platelets", "44"), (2, 4, "Haemoglobin", "14.2")], "doc_id long, claim_id long, raw_name string, value string")
    assert [r["claim_id"] for r in verify.keep_verified(claims, sources).collect()] == [1]
    assert sorted(r["claim_id"] for r in verify.drop_verified(claims, sources).collect()) == [2, 3, 4]


def test_split_long(spark):
    text = " ".join(f"Sentence number {k} is here." for k in range(200))
    pieces = each(spark, split_long("x"), [text, "short"])
    assert pieces[1] == ["short"] and " ".join(pieces[0]) == text and max(map(len, pieces[0])) <= 1100


def test_coerce_details(spark):
    got = each(spark, X.coerce_details("x"), ['```json\n{"what_it_measures": " a ", "lifestyle_suggestions": "- walk\\n- rest"}\n```', "nothing", '{"lifestyle_suggestions": ["x", " "]}'])
    assert got[0]["what_it_measures"] == "a" and got[0]["lifestyle_suggestions"] == ["walk", "rest"] and got[0]["gp_question"] is None
    assert got[1]["lifestyle_suggestions"] is None and got[2]["lifestyle_suggestions"] == ["x"]


PLAIN_PATTERNS = (
    r"(?i)([A-Za-z][A-Za-z0-9\s\(\)\/\-]+):\s*([\d\.]+)\s*([a-zA-Z0-9\/\%µuμ\*\^]+)?",
    r"(?i)([A-Za-z][A-Za-z\s\(\)\/\-]{1,30}?)\s{2,}([\d\.]+)\s*([a-zA-Z0-9\/\%\^]+)?",
    r"(?i)([A-Za-z][A-Za-z0-9\s\(\)\/\-]+)\t+([\d\.]+)\s*([a-zA-Z0-9\/\%\^]+)?",
)


def test_line_patterns_match_what_the_plain_ones_match(spark):
    r = random.Random(8)
    parts = ["A", "b", "Hb", "LDL Chol", "x" * 29, "y" * 31, " ", "  ", "   ", " " * 33, " " * 34, " " * 60, "\t", "\t\t", ":", ": ", "1", "5.4", ".", "g/dL", "%", "(", "-", "/", "é", "µmol", "12", "|", "*"]
    lines = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(6000)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    rows = frame.select("k", *(g.alias(f"g{i}") for i, g in enumerate(extract.line_groups(F.col("line"))))).collect()
    met = 0
    for row in rows:
        line = lines[row["k"]]
        for i, pattern in enumerate(PLAIN_PATTERNS):
            m = re.search(pattern, line, re.ASCII)
            got = row[f"g{i}"].split("\x01")
            if m is None:
                assert len(got) == 1, (line, i)
            else:
                met += 1
                assert (got[0].strip(), *got[1:]) == (m[1].strip(), m[2], m[3] or ""), (line, i)
    assert met > 500


def test_long_lines_and_texts_take_time_by_their_length(spark):
    lines = ["Ab c d-e " * 22000, "a\t" * 100000, "a  " * 66000, "1 - " * 50000, "x" * 200000, " " * 100000 + "5", "Na: " * 50000 + "7"]
    frame = spark.createDataFrame([(x,) for x in lines], "line string").repartition(1)
    began = time.time()
    assert [r[0]["value"] for r in frame.select(extract.pattern_row("line")).collect() if r[0]] == ["7"]
    assert time.time() - began < 10
    text = "A short sentence here. " * 100000
    began = time.time()
    pieces = spark.createDataFrame([(text,)], "t string").select(corpus.split_long("t")).first()[0]
    assert time.time() - began < 20 and " ".join(pieces) == text.strip() and max(map(len, pieces)) <= 1100
