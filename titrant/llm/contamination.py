"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

The index holds the postings (term, document, position) of the training texts for every term that the benchmark uses, and
for each document an end mark whose position is its number of words. Documents stay where they were read, so no text and
no posting of a common word is shuffled to build it.

A window is ``WINDOW`` consecutive words of an item (all of them, where an item has fewer). Windows of equal words are one.
A window's terms are taken from the rarest in the index to the most common: the postings of the rarest, moved by its offset,
are the places where the window may stand; those are intersected with the moved postings of the second rarest, and what
is left, in most corpora the real matches and little else, with those of all the others in the documents concerned.

* exact: all terms stand at their offsets, so the window occurs as a phrase;
* near: each term stands within ``SLACK`` words of its offset from the rarest, of equally rare ones from the first in byte order
  (words put in, left out or swapped).

Work follows the postings of the rarest terms. Joins are by document and position, so neither a term of every text nor
a text of any length meets in one task; the lists of the rarest terms are broadcast up to ``SMALL`` rows, beyond that
their hot keys are dealt over tasks.

Cases: a null text has no words; a document without words and one without benchmark words have their row with zeros;
repeated rows and repeated or missing doc_ids are documents of their own, told apart by their place; rows of equal item_id
are one item in counts and lists, and a null item_id is the empty text; an item without words has no window; equal windows
of several items count for each of them; an empty table gives an empty result, an empty benchmark clean documents;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_places, keep_rows, place, sized_join, spread_join, stored, texts, written

WINDOW, SLACK = 10, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """The words of a text between an empty text first and another one last."""
    plain = F.expr(f"case when octet_length({text}) = char_length({text}) then lower({text}) else translate({text}, '{UPPER}', '{LOWER}') end")
    return F.split(F.concat(F.lit(" "), plain, F.lit(" ")), BREAK, -1)


def windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, words) of each different window, and (words, item_id) of each item that has it."""
    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words("coalesce(text, '')").alias("w"))
    item = item.select("item_id", F.expr("slice(w, 2, size(w) - 2)").alias("w")).where("size(w) > 0").distinct()
    cut = f"explode(transform(sequence(1, greatest(1, size(w) - {WINDOW - 1})), s -> slice(w, s, {WINDOW})))"
    of = written(item.select(F.expr(cut).alias("words"), "item_id").distinct(), "item_windows")
    return written(of.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows"), of


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """file, row, doc_id, at (word number, from 1), id: the index of a ``stored`` table for the terms of ``vocabulary`` (term,
    id). The empty term is the end mark: it stands one place after the last word."""
    each = texts(docs, *place(docs)).select("file", "row", "doc_id", F.posexplode(words("text")).alias("at", "term")).where("at > 0")
    return sized_join(each, vocabulary, "term", "file, row, at").select("file", "row", "doc_id", "at", "id")


def _lookups(window: DataFrame, vocabulary: DataFrame, n: DataFrame) -> DataFrame:
    """window, offset, id, turn: the terms of each window whose terms all have postings, by turn from the rarest (1)."""
    each = window.select("window", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    each = sized_join(written(sized_join(each, vocabulary, "term", "window, offset"), "window_terms"), n, "id", "window, offset")
    own = Window.partitionBy("window")
    each = each.withColumn("turn", F.row_number().over(own.orderBy("n", "term", "offset"))).withColumn("known", F.count(F.lit(1)).over(own))
    return each.where("known = size").select("window", "offset", "id", "turn", "size")


def _meet(asked: DataFrame, index: DataFrame, slack: int) -> DataFrame:
    """Rows of ``asked`` (file, row, want, id, ...) with a posting of the id within ``slack`` of ``want``, ``off`` telling how far
    the nearest is."""
    if slack:
        asked = asked.withColumn("off", F.expr(f"explode(sequence(-{slack}, {slack}))"))
    else:
        asked = asked.withColumn("off", F.lit(0))
    keys = [c for c in asked.columns if c != "off"]
    met = asked.withColumn("at", F.col("want") + F.col("off")).join(index, ["file", "row", "at", "id"])
    return met.groupBy(*keys).agg(F.min(F.abs("off")).alias("off")) if slack else met.select(*keys, "off")


def _found(index: DataFrame, lookups: DataFrame) -> DataFrame:
    """file, row, start, window, size, exact: where windows occur, as a phrase or near. ``index``: postings without end marks."""
    turn = [lookups.where(F.col("turn") == k) for k in (1, 2)]
    first = turn[0].join(turn[1].select("window", F.col("offset").alias("offset_2"), F.col("id").alias("id_2")), "window", "left")
    lists = first.groupBy("id").agg(F.collect_list(F.struct("window", "size", "offset", "offset_2", "id_2")).alias("of"))
    lead = sized_join(index, written(lists, "rarest_terms"), "id", "file, row, at").select("file", "row", "at", F.explode("of").alias("w")).select("file", "row", (F.col("at") - F.col("w.offset")).alias("start"), "w.*")
    lead = written(lead.select("file", "row", "start", "window", "size", "offset_2", "id_2"), "rarest_places")
    seconds = written(turn[1].select("id").distinct(), "second_terms")
    index_2 = sized_join(index, seconds, "id", "file, row, at")
    asked = lead.where("id_2 is not null").select("file", "row", "start", "window", "size", (F.col("start") + F.col("offset_2")).alias("want"), F.col("id_2").alias("id"))
    two = _meet(asked, index_2, SLACK).select("file", "row", "start", "window", "size", "off")
    two = written(two.unionByName(lead.where("id_2 is null").select("file", "row", "start", "window", "size", F.lit(0).alias("off"))), "two_terms_agree", lead)
    # The other terms, in the documents that are left: as a phrase first, then near where a phrase wasn't found.
    rest = lookups.where("turn > 2").groupBy("window").agg(F.collect_list(F.struct("offset", "id")).alias("terms"))  # of one window
    near_by = written(in_places(index, two.select("file", "row")), "postings_of_matches")

    def agree(some: DataFrame, slack: int) -> DataFrame:
        many = spread_join(some, rest, "window", "file, row, start").select("file", "row", "start", "window", "size", F.explode("terms").alias("t"))
        met = _meet(many.select("file", "row", "start", "window", "size", (F.col("start") + F.col("t.offset")).alias("want"), "t.id"), near_by, slack)
        return met.groupBy("file", "row", "start", "window", "size").agg(F.count(F.lit(1)).alias("met")).where("met = size - 2").drop("met")

    short = two.where("size <= 2").select("file", "row", "start", "window", "size", (F.col("off") == 0).alias("exact"))
    long = two.where("size > 2")
    exact = written(agree(long.where("off = 0").drop("off"), 0), "phrases")
    key = ["file", "row", "start", "window"]
    near = agree(long.drop("off").join(exact.select(*key), key, "left_anti"), SLACK)
    return written(short.unionByName(exact.withColumn("exact", F.lit(True))).unionByName(near.withColumn("exact", F.lit(False))), "matches", two, near_by, exact)


def _indexed(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The index with end marks (id -1), the matches, the windows and their items."""
    window, of = windows(benchmark)
    terms = written(window.select(F.explode("words").alias("term")).distinct().withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    end = docs.sparkSession.createDataFrame([("", -1)], "term string, id long")
    index = written(postings(docs, terms.unionByName(end)), "postings")
    plain = index.where("id >= 0").select("file", "row", "at", "id")
    lookups = written(_lookups(window, terms, written(plain.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "term_counts")), "lookups")
    return index, _found(plain, lookups), window, of


def _items(found: DataFrame, window: DataFrame, of: DataFrame) -> DataFrame:
    """file, row, item_id, exact: the items of which a window occurs in a document."""
    pairs = found.groupBy("file", "row", "window").agg(F.max("exact").alias("exact"))
    lists = window.join(of, "words").groupBy("window").agg(F.collect_list("item_id").alias("items"))  # items that share one window
    return spread_join(written(pairs, "window_documents"), lists, "window", "file, row").select("file", "row", "exact", F.explode("items").alias("item_id")).groupBy("file", "row", "item_id").agg(F.max("exact").alias("exact"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, last_word (numbers from 1), exact, phrase: each place where a window of an item occurs."""
    index, found, window, of = _indexed(stored(docs), benchmark)
    out = found.join(index.where("id < 0").select("file", "row", "doc_id"), ["file", "row"])
    named = window.join(of, "words").groupBy("window", "words").agg(F.collect_list("item_id").alias("items"))
    out = spread_join(out, named, "window", "file, row, start").select("doc_id", F.explode("items").alias("item_id"), F.col("start").alias("first_word"), (F.col("start") + F.col("size") - 1).alias("last_word"), "exact", F.array_join("words", " ").alias("phrase"))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside a window that occurs as a phrase), n_items, items_sha256 (of the
    items with such windows), contaminated, n_near_items (items with a window that occurs as a phrase or near)."""
    return _report(stored(docs), benchmark).drop("file", "row")


def _report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    index, found, window, of = _indexed(docs, benchmark)
    hits = found.where("exact").select("file", "row", "start", "size").distinct().select("file", "row", F.expr("explode(sequence(start, start + size - 1))").alias("at")).distinct()
    hits = hits.groupBy("file", "row").agg(F.count(F.lit(1)).alias("n_hit"))
    items = _items(found, window, of).groupBy("file", "row").agg(F.collect_list(F.when(F.col("exact"), F.col("item_id"))).alias("items"), F.count(F.lit(1)).alias("n_near_items"))  # of one document
    ends = index.where("id < 0").select("file", "row", "doc_id", F.col("at").cast("long").alias("n_words"))
    ends = ends.withColumn("n_words", F.col("n_words") - 1)
    out = ends.join(hits, ["file", "row"], "left").join(items, ["file", "row"], "left")
    own = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(own).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(own), ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"), "file", "row",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs as a phrase, with all columns."""
    docs = stored(docs)
    bad = written(_report(docs, benchmark).where("contaminated").select("file", "row"), "contaminated")
    return keep_rows(docs, bad, others=True)


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK.replace("[", "[^", 1)}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK.replace("[", "[^", 1)}') AS w FROM benchmark),
of AS (SELECT DISTINCT item_id, w[s:s + {WINDOW - 1}] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
win AS (SELECT x, len(x) AS k, row_number() OVER () AS v FROM (SELECT DISTINCT x FROM of)),
tok AS (SELECT r, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d),
part AS (SELECT v, k, unnest(x) AS term, unnest(range(0, k)) AS o FROM win),
n AS (SELECT term, count(*) AS n FROM tok WHERE term IN (SELECT term FROM part) GROUP BY 1),
turn AS (SELECT part.*, row_number() OVER (PARTITION BY v ORDER BY n.n, term, o) AS t FROM part JOIN n USING (term)),
whole AS (SELECT v FROM turn GROUP BY v, k HAVING count(*) = k),
lead AS (SELECT r, p - o AS s, v, k FROM turn JOIN tok USING (term) WHERE t = 1 AND v IN (SELECT v FROM whole)),
near AS (
  SELECT l.r, l.s, l.v, l.k, q.o, min(abs(tok.p - l.s - q.o)) AS off
  FROM lead l JOIN part q USING (v) JOIN tok ON tok.r = l.r AND tok.term = q.term AND tok.p BETWEEN l.s + q.o - {SLACK} AND l.s + q.o + {SLACK} GROUP BY ALL),
m AS (SELECT r, s, v, k, max(off) = 0 AS exact FROM near GROUP BY r, s, v, k HAVING count(*) = k),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m WHERE exact) GROUP BY r),
item AS (SELECT r, item_id, bool_or(exact) AS exact FROM m JOIN win USING (v) JOIN of USING (x) GROUP BY r, item_id),
items AS (SELECT r, list_sort(list(item_id) FILTER (WHERE exact)) AS ids, count(*) AS near FROM item GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near, 0) AS n_near_items
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
