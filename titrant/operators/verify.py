"""Checks of extracted rows against their source, and of generated text against its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STRUCTURAL_WORDS, content_tokens, lifestyle_numbers_in, match_form, numbers_in, strip
from ..sources.kept import kept, settled

COVERAGE = 0.6
SAME = 1e-9


def significant_words(name: Column | str) -> Column:
    """Distinct words of a name over two characters that are no report vocabulary; shorter ones, then all, if none is left.

    Repeats of a word count once for each, as places of an array."""
    words = F.filter(F.split(match_form(name), " "), lambda w: w != "")
    plain = F.filter(words, lambda w: ~w.isin(*STRUCTURAL_WORDS))
    long = F.filter(plain, lambda w: F.length(w) > 2)
    return F.when(F.size(long) > 0, long).when(F.size(plain) > 0, plain).otherwise(words)


def value_pattern(value: Column | str) -> Column:
    """A pattern for the digits and points of a value as a whole number, or null without any."""
    digits = F.regexp_replace(F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit("")), r"[^\d.]", "")
    return F.when(digits != "", F.concat(F.lit(r"(?<!\d)"), F.replace(digits, F.lit("."), F.lit(r"\.")), F.lit(r"(?!\d)")))


def _lines(sources: DataFrame, doc: str, text: str, line_no: str | None, *more: str) -> DataFrame:
    """_d, _n, _line of every line that isn't blank, and the columns named in ``more``."""
    place = [F.posexplode(F.split(text, "\n")).alias("_n", "_line")] if line_no is None else [F.col(line_no).alias("_n"), F.col(text).alias("_line")]
    return sources.select(F.col(doc).alias("_d"), *place, *more).where(strip("_line") != "")


def _asked(claims: DataFrame, doc: str, claim: str, name: str, value: str) -> DataFrame:
    """doc, claim, _words, _p (the value's pattern)."""
    return claims.select(F.col(doc), F.col(claim), significant_words(name).alias("_words"), value_pattern(value).alias("_p"))


def _line_words(line: Column | str) -> Column:
    """The words of a line's ``match_form``, blanks among them, in two readings of the line and three of one with parentheses."""
    line = F.col(line) if isinstance(line, str) else line
    bare = F.when(F.contains(line, F.lit("(")), F.regexp_replace(line, r"\(.*?\)", "")).otherwise(line)
    return F.split(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "), " ")


def likely_lines(asked: DataFrame, sources: DataFrame, doc: str = "doc_id", text: str = "text", line_no: str | None = None) -> DataFrame:
    """_d, _n, _line, _has (which of the document's claims' words) of the lines that may bear out a claim of their document.

    asked: doc, _words. A claim needs ``COVERAGE`` of its n words; with d different words of it a line has d and all repeats at
    most, so no line with fewer different words than the least that a claim of its document needs is handed on."""
    n, different = F.size("_words"), F.size(F.array_distinct("_words"))
    least = F.greatest(F.lit(1), F.ceil(n * COVERAGE - SAME) - (n - different))
    own = asked.where(n > 0).groupBy(F.col(doc).alias("_of")).agg(F.array_distinct(F.flatten(F.collect_set("_words"))).alias("_any"), F.min(least).alias("_least"))
    lines = _lines(sources.join(own, F.col(doc) == F.col("_of")), doc, text, line_no, "_any", "_least")
    has = settled(lines.select("_d", "_n", "_line", "_least", F.array_intersect(_line_words("_line"), "_any").alias("_has")))
    return has.where(F.size("_has") >= F.col("_least")).drop("_least")


def looked_up(claims: DataFrame, words: DataFrame, doc: str, claim: str, name: str, value: str) -> DataFrame:
    """doc, claim, _words, _p (the value's pattern) and _word: the words that a claim is looked up by, its document's rarest ones.

    A line that has ``COVERAGE`` of a claim's n words lacks less than the rest, so it has one of any n - least + 1 of them.
    words: _d, _w for each line and word."""
    return _looked_up(_asked(claims, doc, claim, name, value), words, doc, claim)


def _looked_up(asked: DataFrame, words: DataFrame, doc: str, claim: str) -> DataFrame:
    each = asked.withColumn("_word", F.explode("_words"))
    count = words.groupBy("_d", "_w").agg(F.count(F.lit(1)).alias("_f"))
    counted = each.join(count, (F.col(doc) == F.col("_d")) & (F.col("_word") == F.col("_w")), "left").groupBy(doc, claim, "_words", "_p")
    counted = counted.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("_f"), "_word"))).alias("_each"))  # of one name
    repeats = F.size("_each") / F.size("_words")  # rows that agree in all of these columns
    n = F.size("_words")
    most = ((n - F.ceil(n * COVERAGE - SAME) + 1) * repeats).cast("int")
    return counted.select(doc, claim, "_words", "_p", F.explode(F.array_distinct(F.transform(F.slice("_each", F.lit(1), most), lambda x: x["_word"]))).alias("_word"))


def verified(claims: DataFrame, sources: DataFrame, doc: str = "doc_id", claim: str = "claim_id", name: str = "raw_name", value: str = "value", text: str = "text", line_no: str | None = None) -> DataFrame:
    """Keys (doc, claim) of claims with a line of their document that has ``COVERAGE`` of the name's words and the value.

    ``sources`` has one row for each document, or with ``line_no`` one for each line.

    Texts are read once, beside the words of their document's claims; lines with enough of these are kept, with the words they
    have. Claims meet kept lines of their document by the few rarest of their words alone, so words that many lines have join
    nothing.
    """
    asked = kept(_asked(claims, doc, claim, name, value))
    lines = kept(likely_lines(asked, sources, doc, text, line_no))
    words = lines.select("_d", "_n", F.explode("_has").alias("_w"))
    met = _looked_up(asked, words, doc, claim).join(words, (F.col(doc) == F.col("_d")) & (F.col("_word") == F.col("_w"))).select(doc, claim, "_words", "_p", F.col("_n").alias("_at")).distinct()
    there = met.join(lines, (F.col(doc) == F.col("_d")) & (F.col("_at") == F.col("_n")))
    hit = F.size(F.filter("_words", lambda w: F.array_contains("_has", w)))
    return there.where((hit / F.size("_words") >= COVERAGE) & F.coalesce(F.rlike("_line", F.col("_p")), F.lit(True))).select(doc, claim).distinct()


def keep_verified(claims: DataFrame, sources: DataFrame, doc: str = "doc_id", claim: str = "claim_id", **names: str) -> DataFrame:
    return claims.join(verified(claims, sources, doc, claim, **names), [doc, claim], "left_semi")


def drop_verified(claims: DataFrame, sources: DataFrame, doc: str = "doc_id", claim: str = "claim_id", **names: str) -> DataFrame:
    """The claims that their source does not bear out; all of them if it is empty."""
    return claims.join(verified(claims, sources, doc, claim, **names), [doc, claim], "left_anti")


def dropped_report(claims: DataFrame, sources: DataFrame, doc: str = "doc_id", claim: str = "claim_id", name: str = "raw_name", first: int = 10, **names: str) -> DataFrame:
    """doc, n_dropped, names (of the ``first`` by claim), more (whether there are others) for documents with dropped claims."""
    rows = drop_verified(claims, sources, doc, claim, name=name, **names)
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(doc).orderBy(claim, name)))
    shown = F.array_sort(F.collect_list(F.when(F.col("_at") <= first, F.struct("_at", F.coalesce(name, F.lit("")).alias("name")))))  # first at most
    return rows.groupBy(doc).agg(F.count(F.lit(1)).alias("n_dropped"), F.transform(shown, lambda x: x["name"]).alias("names")).withColumn("more", F.col("n_dropped") > first)


def grounded(generated: Column | str, context: Column | str, allowed: Column | None = None) -> Column:
    """Struct ok, reason: blank, off the context's subject, or with figures that neither context nor ``allowed`` have."""
    generated = strip(F.coalesce(F.col(generated) if isinstance(generated, str) else generated, F.lit("")))
    own, theirs = content_tokens(generated), content_tokens(context)
    drift = (F.size(own) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(own, theirs)
    known = F.array_union(F.array_union(numbers_in(context), lifestyle_numbers_in(generated)), F.coalesce(allowed, F.array().cast("array<double>")) if allowed is not None else F.array().cast("array<double>"))
    loose = F.array_sort(F.filter(numbers_in(generated), lambda n: ~F.exists(known, lambda a: F.abs(n - a) < SAME)))
    shown = F.array_join(F.transform(loose, lambda n: F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))), ", ")
    reason = (
        F.when(generated == "", "empty explanation")
        .when(drift, "no subject overlap with the reference context")
        .when(F.size(loose) > 0, F.concat(F.lit("unsourced figures: "), shown))
        .otherwise("ok")
    )
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))


def other_test_named(question: Column | str, own: Column | str, others: Column | str) -> Column:
    """The first of ``others`` whose words, those of the own name apart, are all in the question; else null."""
    asked, mine = content_tokens(question), content_tokens(own)
    others = F.col(others) if isinstance(others, str) else others

    def named(o: Column) -> Column:
        apart = F.array_except(content_tokens(o), mine)
        return (F.size(apart) > 0) & (F.size(F.array_except(apart, asked)) == 0)

    return F.when(F.size(asked) > 0, F.get(F.filter(others, named), F.lit(0)))
