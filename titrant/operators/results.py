"""Result rows: finalisation, best record and first-wins selection, upserts, reassembly, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import BLOOD_TYPES, parse_range, status
from ..functions.text import strip
from .dims import normal_range


def finalise(rows: DataFrame, reference: DataFrame, sex: Column | None = None) -> DataFrame:
    """rows (test_id, value, ref_range, status) with status, llm_status and bounds.

    Bounds are the printed ones, else the static ones for the sex. Blood types are normal and have no bounds.
    """
    sex = F.lit("unknown") if sex is None else sex
    own = reference.select(F.col("test_id").alias("_ref"), *(c for c in reference.columns if c.endswith(("_min", "_max"))))
    out = rows.withColumns({"llm_status": F.col("status"), "test_id": F.coalesce("test_id", F.lit("UNKNOWN_TEST"))})
    out = out.join(F.broadcast(own), F.col("test_id") == F.col("_ref"), "left")
    out = out.withColumns({"_printed": parse_range("ref_range"), "_static": normal_range(sex)})
    lo = F.when(F.col("_printed").isNotNull(), F.col("_printed.lo")).otherwise(F.col("_static.lo"))
    hi = F.when(F.col("_printed").isNotNull(), F.col("_printed.hi")).otherwise(F.col("_static.hi"))
    fixed = F.col("test_id").isin(*BLOOD_TYPES)
    out = out.withColumns({
        "normal_range_min": F.when(~fixed, lo),
        "normal_range_max": F.when(~fixed, hi),
        "status": F.when(fixed, "normal").otherwise(status("value", F.col("_printed"), lo, hi, F.col("llm_status"))),
    })
    return out.drop("_ref", "_printed", "_static", *(c for c in own.columns if c != "_ref"))


def best_record(rows: DataFrame, keys: list[Column | str], order: list[Column], seq: str) -> DataFrame:
    """The row of each key that is first by ``order``, then by ``seq``; ``first_seq`` is the key's first place.

    An aggregation with a map-side part, so that a key with very many rows is one row of each task before the shuffle.
    """
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    first = F.min_by(F.struct(*rows.columns), F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), F.col(seq).alias("_seq")))
    return rows.groupBy(*named).agg(first.alias("_row"), F.min(seq).alias("first_seq")).select("_row.*", "first_seq")


def dedupe(rows: DataFrame, seq: str = "seq", within: tuple[str, ...] = ()) -> DataFrame:
    """One row per id and name (case and outer space apart): one whose range parses, then a known id, then the first."""
    keys = [*within, F.coalesce("test_id", F.lit("UNKNOWN_TEST")), F.lower(strip(F.coalesce("raw_name", F.lit(""))))]
    return best_record(rows, keys, [parse_range("ref_range").isNull(), ~F.coalesce("known", F.lit(False))], seq)


def first_wins(rows: DataFrame, keys: list[Column | str], seq: str) -> DataFrame:
    return best_record(rows, keys, [], seq).drop("first_seq")


def merge_continuations(rows: DataFrame, group: str, order: str, is_row: Column, text: str) -> DataFrame:
    """Rows with the texts of the other rows that follow them joined by a space; others before the first row go."""
    place = F.sum(is_row.cast("long")).over(Window.partitionBy(group).orderBy(order))
    islands = rows.withColumns({"_row": place, "_is": is_row}).where("_row > 0").groupBy(group, "_row")
    more = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_is"), F.struct(order, text)))), lambda x: x[text])
    out = islands.agg(F.min(order).alias(order), F.max(F.when(F.col("_is"), F.col(text))).alias(text), more.alias("_more"))
    return out.withColumn(text, strip(F.concat_ws(" ", text, F.array_join("_more", " ")))).drop("_row", "_more")


def fingerprint(text: Column | str, chars: int = 200) -> Column:
    return F.lower(F.substring(text, 1, chars))


def upsert(entries: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """Last value of each key at the key's first place."""
    return entries.groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.min(seq).alias("first_seq"))


def upsert_entries(entries: DataFrame, name: str, seq: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Typed entries, of those with one name (case and outer space apart) the last, at the first one's place."""
    key = F.lower(strip(F.coalesce(name, F.lit(""))))
    rows = entries.withColumn("_seq", F.col(seq)).withColumn("_key", key).where("_key != ''")
    last = F.max_by(F.struct(*entries.columns), "_seq")
    out = rows.groupBy(*within, "_key").agg(last.alias("_row"), F.min("_seq").alias("first_seq"))
    return out.select("_row.*", "first_seq")


def union_merge(rows: DataFrame, key: str, ids: str, label: str, seq: str) -> DataFrame:
    """Ids of a key over all its rows in first-seen order; the first label wins. Hot keys: ids are pre-aggregated."""
    each = rows.select(key, F.posexplode(ids).alias("_p", "id"), seq).groupBy(key, "id").agg(F.min(F.struct(seq, "_p")).alias("at"))
    merged = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias(ids))
    labels = rows.groupBy(key).agg(F.min_by(label, seq).alias(label), F.min(seq).alias("first_seq"))
    return labels.join(merged, key, "left").withColumn(ids, F.coalesce(ids, F.array().cast("array<string>")))


def assign_batches(rows: DataFrame, within: list[str], order: list[str], size: int = 6) -> DataFrame:
    """batch: place within the group over ``size``, from 0."""
    at = F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(at / size).cast("long"))


def history(reports: DataFrame, owner: str, saved: str) -> DataFrame:
    """Saved reports of each owner, newest first: place counts from 1, of equal times the later row by all columns first."""
    rest = [F.col(c).desc() for c in reports.columns if c not in (owner, saved)]
    return reports.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.col(saved).desc(), *rest)))


def cache_misses(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key, nulls being equal, is not in the cache."""
    other = cache.select(*(F.col(k).alias(f"_{k}") for k in keys))
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(other, match, "left_anti")


def reassemble(slots: DataFrame, details: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Slots with their details by key; what is missing has its default."""
    out = slots.join(details, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


# Texts of a report's summary.
NO_QUESTION = "Routine follow-up"
NO_SUGGESTION = "Focus on balanced nutrition, adequate hydration, and regular activity."
CLOSING = "Always discuss your specific results with your GP or healthcare provider."
OVERALL = (
    "This report explains ", " from your results. Each explanation below describes what the test measures and general, NHS/NIH-grounded habits "
    "that support that area of health. It does not interpret your specific values, so please review your actual results with your GP.",
)


def report_summary(results: DataFrame, report: str, seq: str, question: str, suggestion: str) -> DataFrame:
    """Per report: number of tests, non-blank questions of its first three results (else a default), first suggestion, and
    the texts around them. No generator is asked, so no summary is ever degraded."""
    place = F.row_number().over(Window.partitionBy(report).orderBy(seq))
    ranked = results.withColumn("_at", place)
    asked = F.transform(F.array_sort(F.collect_list(F.when((F.col("_at") <= 3) & (strip(F.coalesce(question, F.lit(""))) != ""), F.struct("_at", F.col(question).alias("q"))))), lambda x: x["q"])
    first = F.min_by(suggestion, F.when(strip(F.coalesce(suggestion, F.lit(""))) != "", F.col("_at")))
    out = ranked.groupBy(report).agg(F.count(F.lit(1)).alias("n_tests"), asked.alias("questions"), first.alias("first_suggestion"))
    counted = F.concat(F.col("n_tests").cast("string"), F.when(F.col("n_tests") == 1, " test").otherwise(" tests"))
    return out.withColumns({
        "first_suggestion": F.coalesce("first_suggestion", F.lit(NO_SUGGESTION)),
        "questions": F.when(F.size("questions") > 0, F.col("questions")).otherwise(F.array(F.lit(NO_QUESTION))),
        "overall_summary": F.concat(F.lit(OVERALL[0]), counted, F.lit(OVERALL[1])),
        "closing_message": F.lit(CLOSING),
        "summary_degraded": F.lit(False),
    })
