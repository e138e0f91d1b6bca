"""The versioned cache, what is put into it by flows, units of precomputation and breakers that waves share."""

import glob
import json
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from titrant.operators import explain, results, retrieve, verify
from titrant.plans import policy, reports
from titrant.sources import cache as caches
from titrant.sources import tables
from titrant.sources.cache import CacheTable

SCHEMA = "k string, v string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def held(table):
    return {r["k"]: r["v"] for r in table.read().collect()}


class Killed(Exception):
    pass


def test_a_save_that_dies_anywhere_loses_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(caches, "MOST_PARTS", 3)
    monkeypatch.setattr(caches, "KEPT", 1)
    monkeypatch.setattr(caches, "ORPHAN_HOURS", 0.0)
    path = f"{tmp_path}/cache"
    CacheTable(spark, path, SCHEMA, ["k"]).save(rows(spark, ("a", "0"), (None, "n")))
    known, died = {"a": "0", None: "n"}, 0

    class Dying(CacheTable):
        left = 1 << 30

        def _path(self, *below):
            self.left -= 1
            if self.left < 0:
                raise Killed
            return super()._path(*below)

    for step in range(200):
        table = Dying(spark, path, SCHEMA, ["k"])
        table.left = step
        new = known | {"a": str(step), f"k{step % 5}": str(step)}
        try:
            table.save(rows(spark, ("a", str(step)), (f"k{step % 5}", str(step))))
            whole = True
        except Killed:
            whole, died = False, died + 1
        now = held(CacheTable(spark, path, SCHEMA, ["k"]))
        assert now == new if whole else now in (known, new)
        known = now
        if whole:
            break
    assert died > 8 and CacheTable(spark, path, SCHEMA, ["k"]).save(rows(spark, ("z", "1")))
    assert held(CacheTable(spark, path, SCHEMA, ["k"])) == known | {"z": "1"}


def test_two_writers_both_land(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/cache"
    table = CacheTable(spark, path, SCHEMA, ["k"])
    table.save(rows(spark, ("a", "1")))
    first, publish = [True], CacheTable._publish

    def late(self, version, parts):
        if first:  # another writer comes in between
            first.clear()
            assert CacheTable(spark, path, SCHEMA, ["k"]).save(rows(spark, ("b", "2"), ("c", "2")))
        return publish(self, version, parts)

    monkeypatch.setattr(CacheTable, "_publish", late)
    assert table.save(rows(spark, ("c", "3"))) and held(table) == {"a": "1", "b": "2", "c": "3"}
    monkeypatch.undo()
    threads = [threading.Thread(target=lambda n=n: CacheTable(spark, path, SCHEMA, ["k"]).save(rows(spark, (f"t{n}", "x")))) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert set(held(table)) == {"a", "b", "c", "t0", "t1", "t2", "t3"}


def test_old_versions_and_plain_tables(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/cache"
    rows(spark, ("a", "1"), (None, "2")).write.parquet(path)  # an older cache without versions
    for k in range(6):
        assert tables.save_cache(spark, rows(spark, ("a", str(k)), ("a", str(k))), ["k"], path, SCHEMA)
    assert sorted(map(tuple, tables.read_cache(spark, path, SCHEMA).collect()), key=str) == [("a", "5"), (None, "2")]
    table = CacheTable(spark, path, SCHEMA, ["k"])
    assert table.versions() == [4, 5, 6] and table.live()[0] == 6
    before = table.read()
    monkeypatch.setattr(caches, "MOST_PARTS", 2)
    table.save(rows(spark, ("b", "1")))
    assert len(table.live()[1]) == 1 and before.count() == 2 and held(table) == {"a": "5", None: "2", "b": "1"}


TESTS = "slot long, report_id long, test_id string, specimen string, raw_name string, unit string"


def corpus(spark, n):
    names = "Alphin Betarol Gammose Deltide Epsilase Zetanol Etamine Thetane Iotase Kappane Lambdol Mutane".split()[:n]
    ref = spark.createDataFrame([(f"T{k}", "NHS", f"{names[k]} counts something here.") for k in range(n)], "test_id string, source string, plain_english string")
    chunks = spark.createDataFrame([(k, [f"T{k}"], names[k], names[k], f"{names[k]} counts something.", "u", "NIH") for k in range(n)], "id long, test_ids array<string>, topic string, section string, text string, url string, source string")
    return names, ref, retrieve.embed(chunks, "text")


def model(log, names, down=(), name="up"):
    def call(prompt, entry):
        ids = [line.split("|")[0].split(":")[1].strip() for line in prompt.split("\n") if line.startswith("- Test ID")]
        with open(log, "a") as f:
            f.write(f"{name} {' '.join(ids)}\n")
        if name in down:
            raise ValueError("HTTP 503")
        return json.dumps({"explanations": [{"test_id": i, "what_it_measures": f"{names[int(i[1:])]} counts something.", "lifestyle_suggestions": ["Walk"], "gp_question": f"What is {names[int(i[1:])]}?"} for i in ids if i != "T2"]})

    return call


def test_a_second_report_generates_nothing(spark, tmp_path):
    names, ref, chunks = corpus(spark, 5)
    log, path = str(tmp_path / "log"), f"{tmp_path}/cache"
    chain = policy.Chain({"up": model(log, names)}, policy.Settings(text_chain=("up",)), sleep=lambda s: None)
    tests = [(k, 1, f"T{k}", None, names[k], "x") for k in range(5)]
    say = lambda some: {r["slot"]: r for r in reports.explain_and_cache(spark, spark.createDataFrame(some, TESTS), ref, chunks, path, generator=policy.generator(chain)).collect()}
    one = say(tests)
    assert [k for k in one if one[k]["degraded"]] == [2] and "generated" not in one[0].asDict()
    kept = {r["test_id"]: r for r in reports.explanation_cache(spark, path).read().collect()}
    assert sorted(kept) == ["T0", "T1", "T3", "T4"] and kept["T1"]["what_it_measures"] == "Betarol counts something."
    asked = open(log).read()
    two = say([(10 + k, 2, *t[2:]) for k, t in enumerate(tests) if t[2] != "T2"])
    assert open(log).read() == asked and all(not r["degraded"] for r in two.values()) and two[11]["what_it_measures"] == one[1]["what_it_measures"]
    say([(20, 3, "T3", "urine", names[3], "x")])  # another specimen is another entry
    assert len(open(log).read()) > len(asked) and reports.explanation_cache(spark, path).read().count() == 5


def test_a_failed_precomputation_repeats_one_unit_at_most(spark, tmp_path):
    n = 12
    names, ref, chunks = corpus(spark, n)
    log, path = str(tmp_path / "log"), f"{tmp_path}/cache"
    failing = [True]

    def generator(broken):
        def answers(frame: pd.DataFrame) -> pd.DataFrame:
            out = []
            for t in frame.itertuples():
                with open(log, "a") as f:
                    f.write(t.test_id + "\n")
                if broken and len(open(log).read().split()) == 8:
                    raise ValueError("provider gone")
                name = t.raw_name
                out.append((t.slot, f"{t.text.split(') ')[1].split()[0]} counts something.", ["something counts"], "What counts something?"))
                del name
            return pd.DataFrame(out, columns=["slot", "what_it_measures", "lifestyle_suggestions", "gp_question"])

        return answers

    with pytest.raises(Exception, match="provider gone"):
        reports.precompute_into(spark, ref, chunks, path, generator(failing), unit=3)
    done = {r["test_id"] for r in reports.explanation_cache(spark, path).read().collect()}
    asked = open(log).read().split()
    assert 3 <= len(done) < n and len(set(asked) - done) <= 3
    table = reports.precompute_into(spark, ref, chunks, path, generator([]), unit=3)
    again = open(log).read().split()[len(asked) :]
    assert {r["test_id"] for r in table.read().collect()} == {f"T{k}" for k in range(n)} and not set(again) & done and len(again) == n - len(done)
    reports.precompute_into(spark, ref, chunks, path, generator([]), unit=3)
    assert len(open(log).read().split()) == len(asked) + len(again)
    short = reports.precompute_into(spark, ref, chunks, f"{tmp_path}/short", generator([]), measures_only=True, unit=5)
    assert short.read().columns == ["test_id", "what_it_measures"] and short.read().count() == n


def test_a_provider_found_down_is_left_out_of_the_next_wave(spark, tmp_path):
    names, ref, _ = corpus(spark, 12)
    log = str(tmp_path / "log")
    tests = spark.createDataFrame([(k, k // 4, f"T{k}", None, names[k], "x", f"T{k}") for k in range(12)], TESTS + ", grounding_id string")
    none = spark.createDataFrame([], "slot long, rank int, text string, source string, url string")
    bundled = explain.bundle(tests, ref, none)
    providers = {name: model(log, names, ("down",), name) for name in ("down", "up")}
    chain = policy.Chain(providers, policy.Settings(text_chain=("down", "up"), retries=1), sleep=lambda s: None)
    out = explain.explain(bundled, spark.createDataFrame([], reports.ENTRY), generator=policy.generator(chain)).collect()
    assert sum(r["degraded"] for r in out) == 1
    lines = [line.split() for line in open(log).read().splitlines()]
    assert [x for x in lines if x[0] == "down"] and not [x for x in lines if x[0] == "down" and x[1:] == ["T2"]]  # T2 alone is asked for in later waves
    assert [x for x in lines if x == ["up", "T2"]]
    knowing = policy.generator(chain).knowing({"down": 1e12})
    assert knowing.chain.order() == ["up"] and set(knowing.chain.opened()) == {"down"} and policy.generator(chain).chain.order()[0] == "down"


def test_no_temporary_files_stay_in_the_manifests(spark, tmp_path):
    table = CacheTable(spark, f"{tmp_path}/c", SCHEMA, ["k"])
    table.save(rows(spark, ("a", "1")))
    assert [p for p in glob.glob(f"{tmp_path}/c/_live/.*") if not p.endswith(".crc")] == []
    assert table.read().where(F.col("k") == "a").count() == 1


def test_cases_are_evaluated_by_their_texts(spark, tmp_path):
    names, ref, chunks = corpus(spark, 3)
    cases = spark.createDataFrame([(k, "blood" if k < 2 else "urine", names[k], "5", "g") for k in range(3)] + [(9, "urine", "Nowhere Found", "1", "g")], "slot long, category string, raw_name string, value string, unit string")
    fine = lambda b: pd.DataFrame({"slot": b["slot"], "what_it_measures": [t.split(") ")[1].split("\n")[0] for t in b["text"]], "lifestyle_suggestions": [["Walk", "Sleep"]] * len(b), "gp_question": "What counts something?"})
    rows, total = reports.evaluate_cases(spark, cases, ref.withColumn("test_id", F.upper(F.split("plain_english", " ")[0])), chunks, f"{tmp_path}/eval", fine)
    got = {r["slot"]: r for r in rows.collect()}
    assert all(got[k]["grounding_pass"] and got[k]["completeness"] and got[k]["fk_grade"] is not None for k in range(3)) and got[9]["ungrounded"] and not got[9]["grounding_pass"]
    whole = {r["category"]: r for r in total.collect()}
    assert whole["Overall"]["n"] == 4 and whole["Overall"]["accuracy_pct"] == 75.0 and whole["blood"]["accuracy_pct"] == 100.0
    assert spark.read.option("header", True).csv(f"{tmp_path}/eval/rows").count() == 4 and spark.read.json(f"{tmp_path}/eval/summary").count() == 3


def test_dropped_names_and_history(spark):
    claims = spark.createDataFrame([(1, k, f"Ghost {k:02d}", "1") for k in range(12)] + [(1, 50, "Ferritin", "88"), (2, 1, "Ferritin", "5")], "doc_id long, claim_id long, raw_name string, value string")
    texts = spark.createDataFrame([(1, "Ferritin 88"), (2, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in verify.dropped_report(claims, texts).collect()}
    assert got[1]["n_dropped"] == 12 and got[1]["names"] == [f"Ghost {k:02d}" for k in range(10)] and got[1]["more"] and (got[2]["names"], got[2]["more"]) == (["Ferritin"], False)
    saved = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 3, "z")], "owner string, saved long, title string")
    assert [(r["title"], r["place"]) for r in results.history(saved, "owner", "saved").orderBy("owner", "place").collect()] == [("z", 1), ("y", 2), ("x", 3), ("z", 1)]
