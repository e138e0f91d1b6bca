"""The pipeline's stages against brute force on small fixtures, and the guard of the driver's entry."""

import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from titrant.llm import common
from titrant.llm.common import written

ROOT = Path(__file__).resolve().parents[2]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("the ing er on tion ly en ver que ment".split()) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_stages(spark, tmp_path):
    good = [(k, prose(k, 60)) for k in range(200)]
    bad = [(1000 + k, " ".join(w + "***" for w in prose(500 + k, 60).split())) for k in range(200)]
    extra = [(3000, good[3][1]), (3001, good[4][1] + "   "), (3002, None), (3003, "token = \"0123456789abcdef0123456789abcdef\" " + prose(9000, 50)), (2, good[2][1])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in good + bad + extra]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert len(seen[0].keys() & set(range(200))) > 190 and len(seen[0].keys() & {i for i, _ in bad}) < 20
    assert 3000 not in seen[1] and 3001 in seen[1] and 4 not in seen[1] and docs.where("doc_id = 2").count() == 1
    assert seen[1].keys() >= seen[2].keys() == seen[3].keys()
    assert "[SECRET]" in seen[3][3003] and "0123456789abcdef" not in seen[3][3003]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(seen[3])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]


def test_pipeline_leaves_one_stage_behind(spark, tmp_path, monkeypatch):
    rows = [(k, prose(k, 40), "en", "s", 1, f"f{k}") for k in range(40)] + [(None, prose(90, 40), "en", "s", 1, "x"), (None, prose(91, 40), "en", "s", 1, "x"), (3, prose(92, 40), None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, file string").write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/in/labels.parquet")
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/in")
    assert sorted(r["doc_id"] or -1 for r in packed.collect()) == sorted(r[0] or -1 for r in rows)  # no text is lost
    assert {p.name.rsplit("-", 1)[0] for p in (tmp_path / "shared").iterdir() if not p.name.startswith(".")} <= {"secret_scans", "pieces"}


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_a_doc_id_or_have_none_are_kept(spark):
    rows = [(None, prose(20, 60)), (None, prose(21, 60)), (7, prose(22, 60)), (7, prose(23, 60)), (7, prose(23, 60)), (None, prose(20, 60)), (8, "a b"), (8, "a  b"), (1, "a   b")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    want = {*rows[:4], rows[8]}
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        kept = stage(spark, docs.where("doc_id is null or doc_id <> 8") if stage is corpus_pipeline.drop_near_copies else docs, "")
        found = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert kept.columns == docs.columns and len(found) == len(want) and set(found) == want
    longest = corpus_pipeline.drop_exact_copies(spark, docs.where("doc_id = 8"), "").collect()
    assert [r["text"] for r in longest] == ["a  b"]


def test_entry_works_without_the_corpus_queries(tmp_path):
    for name in ("__spark_entry__.py", "titrant"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    code = "import __spark_entry__ as e; print(len([k for k in e.queries() if k.startswith('op') or k == 'pipeline']), len(e.queries()) > 40)"
    run = lambda: subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": ""}, capture_output=True, text=True).stdout.split()
    assert run() == ["0", "True"]
    subprocess.run(["rm", "-r", str(tmp_path / "titrant" / "llm")], check=True)
    assert run() == ["0", "True"]
