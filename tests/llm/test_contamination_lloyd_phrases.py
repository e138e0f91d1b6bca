"""Benchmark decontamination, dual-tree clustering and phrase mining against brute force, on hard rows."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from titrant.llm import common, contamination, lloyd, phrases, pii

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("the ing er on tion ly en ver".split()) for _ in range(r.randint(1, 2))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    item = prose(1, 14)
    texts = [
        None, "", " .,\n", "ÉÀ é à İ", prose(2, 40) + " " + item.upper() + "; " + prose(3, 30), item, item, " ".join(item.split()[:9]), " ".join(item.split()[2:13]), prose(4, 4000) + " " + item,
        "short one", "a SHORT one, short-one", "x y x y x y " * 20, "naïve Éa éa " * 4, "1 2 3 4 5 6 7 8 9 10 11",
    ] + [item.replace(" ", " and ", 1) + f" tail {k}" for k in range(3)] + [prose(5, 60)] * 40
    rows = [(k if k % 7 else None, t, "en" if k % 3 else None, "key", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, words string, at int").repartition(3).cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    item = prose(1, 14)
    rows = [(1, item, "z"), (2, item, "z"), (3, "Short, ONE", "z"), (None, "naïve Éa", "z"), (4, "", "z"), (5, None, "z"), (6, "x y x y x y x y x y x", "z"), (7, "1 2 3 4 5 6 7 8 9 10 12", "z"), (8, "nowhere to be found", "z"), (8, "éa éa", "z"), (9, "a", "z")]
    return spark.createDataFrame(rows, "item_id long, text string, words string")


def contaminated(docs, benchmark):
    found = collections.defaultdict(set)
    for i, t, *_ in benchmark:
        w = WORD.findall((t or "").translate(LOW))
        for s in range(max(1, len(w) - 9) if w else 0):
            found[tuple(w[s : s + 10])].add("" if i is None else str(i))
    out = []
    for i, t, *_ in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, items = set(), set()
        for k in {len(x) for x in found}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in found:
                    items |= found[tuple(w[s : s + k])]
                    hit |= set(range(s, s + k))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [common.SMALL, 0])
def test_contamination(spark, docs, benchmark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL", small)  # nothing is broadcast: hot terms are spread
    rows = contamination.contamination(docs, benchmark).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=str) == contaminated(docs.collect(), benchmark.collect())
    assert all(r["n_near_items"] >= r["n_items"] for r in rows)


def test_contamination_cases(spark, docs, benchmark):
    near = [r for r in contamination.matches(docs, benchmark).collect() if not r["exact"]]
    assert {r["item_id"] for r in near} >= {"1", "2"} and all(r["first_word"] >= 0 for r in near)  # a word put in
    rows = docs.collect()
    clean = sum(not r[5] for r in contaminated(rows, benchmark.collect()))
    left = contamination.drop_contaminated(docs, benchmark)
    assert left.count() == clean and left.columns == docs.columns
    assert contamination.contamination(docs.where("false"), benchmark).count() == 0
    assert {(r["n_hit"], r["contaminated"]) for r in contamination.contamination(docs, benchmark.where("false")).collect()} == {(0, False)}


def test_places_by_runs_of_blocks(spark, tmp_path, monkeypatch):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "cast(id % 7 as string) as v")
    docs.coalesce(1).write.parquet(str(tmp_path / "long"))
    docs = spark.read.parquet(str(tmp_path / "long"))
    kept = docs.select("id", *common.place(docs)).where("id % 3 = 0").drop("id")
    for name, value in (("BLOCK", 64), ("MOST", 4), ("RUN", 2), ("BRANCHES", 3)):
        monkeypatch.setattr(common, name, value)
    got = common.keep_rows(docs, kept)
    assert sorted(r["id"] for r in got.collect()) == list(range(0, 3000, 3))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2 * 3
    assert sorted(r["id"] for r in common.keep_rows(docs, kept, others=True).collect()) == [k for k in range(3000) if k % 3]


def brute_lloyd(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) if abs(float(x)) < 1e300 else int(float(x)) * 64 for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    cents = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[0] or 0, r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in kept:
            groups[near(x)[1]].append(x)
        cents = [[sum(v) // len(groups[j]) for v in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(cents)]
    most = (1 << 63) - 1
    out = [(i, near(x)[1], min(most, near(x)[0])) for i, x in kept]
    own = collections.Counter()
    for _, c, d in out:
        own[c] += d
    return sorted(((i, c, d, min(most, own[c]), min(most, sum(own.values())), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out), key=str)


def vectors(r, n):
    base = r.normal(0, 0.3, (8, 64))
    return [[float(x) for x in base[r.integers(8)] + r.normal(0, 0.05, 64)] for _ in range(n)]


def test_lloyd(spark):
    r = np.random.default_rng(3)
    rows = list(enumerate(vectors(r, 120)))
    rows += [(200 + k, rows[5][1]) for k in range(60)] + [rows[7], (None, rows[9][1]), (400, None), (401, []), (402, [0.0] * 63), (403, [float("nan")] * 64), (404, [float("inf")] * 64), (405, [None] * 64), (406, [0.5] * 65)]
    table = spark.createDataFrame([(i, e, "c") for i, e in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    assert sorted(map(tuple, lloyd.cluster(table).collect()), key=str) == brute_lloyd(rows)
    few = rows[:5]
    assert sorted(map(tuple, lloyd.cluster(table.where("vec_id < 5")).collect()), key=str) == brute_lloyd(few)
    assert lloyd.cluster(table.where("false")).count() == 0


def test_lloyd_of_huge_components(spark):
    r = np.random.default_rng(4)
    rows = [(k, [x * 10.0 ** (k % 5 * 70) for x in e]) for k, e in enumerate(vectors(r, 40))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, lloyd.cluster(table, rounds=3).collect()), key=str) == brute_lloyd(rows)


@pytest.mark.parametrize(("n", "d", "k", "spread"), [(1500, 64, 16, 30), (900, 3, 16, 60), (400, 2, 9, 2), (1, 5, 1, 3)])
def test_both_trees_agree_with_every_pair(n, d, k, spread):
    r = np.random.default_rng(n)
    points = np.unique(np.floor(r.normal(0, spread, (n, d))).astype(np.int64), axis=0)
    tree = lloyd.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    place = np.zeros(len(points), np.int64)
    place[tree.order] = np.arange(len(points))
    fields = {name: place[tree.centre] if name == "centre" else getattr(tree, name) for name, _ in lloyd.FIELDS}
    own = points[tree.order]
    for c, a, b, far in zip(fields["centre"], fields["first"], fields["last"], fields["radius"], strict=True):
        assert np.sqrt(((own[a:b] - own[c]) ** 2).sum(axis=1)).max() <= far + 1e-9 and a <= c < b
    cents = points[r.integers(0, len(points), k)].tolist()
    cents += cents[:1]  # an equal centroid never wins
    want = ((own[:, None] - np.array(cents)[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (lloyd.assign(own, fields, cents) == want).all()


def brute_phrases(rows, first=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(LOW)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[s : s + k])) for s in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= 10:
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((p, a, f[lang, p[:k]], f[lang, p[k:]], score))
    rows = []
    for lang, found in out.items():
        most = collections.Counter()
        for p, a, *_ in found:
            for q in (p[:2], p[1:]) if len(p) == 3 else ():
                most[q] = max(most[q], a)
        stay = sorted((x for x in found if len(x[0]) == 3 or not most[x[0]] or 100 * most[x[0]] < 50 * x[1]), key=lambda x: (-x[4], -x[1], " ".join(x[0]).encode()))
        rows += [(lang, k + 1, " ".join(p), a, le, r, n[lang], s) for k, (p, a, le, r, s) in enumerate(stay[:first])]
    return sorted(rows)


def test_phrases(spark, docs):
    r = random.Random(5)
    rows = [(None if k % 5 == 0 else "en" if k % 2 else "fr", " ".join(r.choice("the of cat Sat. on, mat é É ￿ 𐀀 a\tb".split(" ")) for _ in range(r.randint(0, 60)))) for k in range(200)] + [("en", None), ("en", ""), ("en", "new york city " * 3000)]
    table = spark.createDataFrame([(k, t, x, 1) for k, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, n int").repartition(4)
    assert sorted(map(tuple, phrases.collocations(table).collect())) == brute_phrases(rows)
    assert sorted(map(tuple, phrases.collocations(table, first=3).collect())) == brute_phrases(rows, 3)
    assert phrases.collocations(table.where("false")).count() == 0
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute_phrases([(x["lang"], x["text"]) for x in docs.collect()])


@pytest.mark.parametrize(("words", "block", "pieces", "bounds"), [(50, 40, 1, 0), (50, 16, 1, 9), (300, 64, 3, 5), (10**6, 10**6, 2, 30)])
def test_tries_cut_anywhere_add_up(monkeypatch, words, block, pieces, bounds):
    """Small shards, blocks, ranges and hash pieces: the merged nodes are the phrases counted plainly, none twice."""
    monkeypatch.setattr(phrases, "SHARD_WORDS", words)
    monkeypatch.setattr(phrases, "TEXT_BLOCK", block)
    r = random.Random(words)
    texts = [" ".join(r.choice("the of cat sat. on, mat a an the the".split()) for _ in range(r.randint(0, 200))) for _ in range(12)]
    found = sorted({p[: r.randint(1, 3)] for t in texts for p in phrases.paths(t)})
    cuts = sorted(r.sample(found, min(bounds, len(found))))
    groups = collections.defaultdict(list)
    for half in (texts[:5], texts[5:]):
        shard = phrases.Shard(cuts, pieces)
        for row in itertools.chain(*(list(shard.add("en", t)) for t in half), shard.cut()):
            groups[row[0]].append(row[2])
    got, total = collections.Counter(), 0
    f = collections.Counter()
    for t in texts:
        for piece in re.split("[.,;:!?\n-\r]", t):
            w = piece.split()
            for k in (1, 2, 3):
                f.update(" ".join(w[s : s + k]) for s in range(len(w) - k + 1))
    for part, tries in groups.items():
        n, nodes = phrases.merged(tries, cuts[part // pieces - 1] if part // pieces else (), part % pieces == 0, 1)
        total += n
        for depth, p, count, n1, n2 in nodes:
            got[p.decode()] += count
            w = p.decode().split()
            assert len(w) == depth and (depth == 1 or n1 == f[w[0]]) and (depth < 3 or n2 == f[" ".join(w[:2])])
    assert got == f and total == sum(c for p, c in f.items() if " " not in p)


def test_phrases_are_ranked_in_salts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED", 4)
    r = random.Random(6)
    rows = [("en" if k % 4 else "fr", " ".join(r.choice("the of cat sat mat on a an".split()) for _ in range(60))) for k in range(120)]
    table = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(table, first=3).collect())) == brute_phrases(rows, 3)


def test_pii_of_copied_lists_pairs_classes(spark):
    """Two documents that share a list of 2,000 addresses and 4,000 terms: 8 million pairs of entities and terms, one of classes."""
    listed = " ".join(f"user{k}@corp{k}.org surname{chr(97 + k % 26)}{'abcdefghij'[k // 26 % 10]}{'klmnopqrst'[k // 260]}" for k in range(2000))
    rows = [(0, listed + " alpha"), (1, "beta " + listed)] + [(k, f"plain words {k} about other things here") for k in range(2, 60)] + [(60, "user1@corp1.org alone with plain words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        began = time.time()
        found = {r["doc_id"]: r for r in pii.find(docs).collect()}
        assert time.time() - began < 60
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found[0]["n_email"] == 2000 and found[0]["n_term"] == found[1]["n_term"] > 1000 and found[5]["n_term"] == 0
