"""Columns for names, values, units, tokens and numbers in report text. All are built-in expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that define the results.
QUALIFIERS = r"(?i)\b(serum|plasma|urine|urinary|edta\s*blood|whole\s*blood|fluoride\s*plasma|\d+\s*hour(?:s)?|qualitative|quantitative|random\s*sample)\b"
IN_SPECIMEN = r"(?i)[\[\(]\s*in\s+(urine|blood|serum|plasma|stool|csf)\s*[\]\)]"
URINE_WORD = r"(?i)\b(urine|urinary)\b"
FLAG = r"(?:^|\s)([HL])(?:\s|$)"
TRAILING_MARK = r"\s*[\(\[][+-][\)\]]\s*$"
FOOTER = r"(?i)\s*(page\s+\d+\s+of\s+\d+|#\s*referred\s+test|dr\.?\s*[a-z]|\bmd\s*path\b|\bm\.?d\.?\b\s*\(|end of report).*$"
FOOTER_HAS = ("page", "#", "dr", "md", "m.d", "end of report")
UNIT_WITH_RANGE = r"^([^\s\d]{1,12})\s+(-?\d+\.?\d*\s*-\s*-?\d+\.?\d*)$"
COUNT_RANGE = r"^(\d+)\s*-\s*(\d+)$"
CATEGORICAL_NAME = r"(?i)\b(abo|blood\s*group|rh\s*\(?d\)?)\b"
NOT_A_TEST = (
    r"(?i)^\s*(dr\.?|prof\.?|m\.?d\.?|mbbs|dnb|md\s*\(|consultant|pathologist|technologist|signature|verified|authoris|authoriz|approved|"
    r"end of report|interpretation|note|comment|remark|final result|overall result|overall interpretation|test result|(urine\s+)?quantity\s*$|"
    r"age|sex|gender|pid|patient\s*(id|name|location)?\s*$|client(\s*(name|code|address|add|no))?\s*$|"
    r"(registered|collected|reported|generated|approved|received|ordered)\s*(on|by|location)?\s*$|sample\s*collection(\s*by)?\s*$|"
    r"ref(erence)?\s*(id\s*#?\d*|by|doctor)?\s*$|mrn|uhid|visit\s*type\s*$|investigation\s+result(\s+reference\s*value)?\s*$)"
)
QUALITATIVE = (
    "negative", "positive", "nil", "absent", "present", "trace", "clear", "reactive", "non-reactive", "normal", "abnormal", "detected",
    "not detected", "pale yellow", "yellow", "straw", "cloudy", "turbid",
)
URINE_SECTION = (
    r"(?i)\b(urinalysis|urine\s+(examination|analysis|routine|r\s*/\s*e)|routine\s+urine\s+examination|sample\s+type\s*:?\s*urine|"
    r"physical\s*&?\s*chemical\s+examination)\b"
)
STRUCTURAL_WORDS = (
    "test", "tests", "result", "results", "unit", "units", "biological", "reference", "interval", "range", "normal", "value", "values",
    "method", "count", "level", "levels", "laboratory", "report", "sample", "patient", "name", "date", "page",
)
ANCHOR_STOPWORDS = (
    "test", "tests", "testing", "blood", "level", "levels", "count", "counts", "panel", "result", "results", "screening", "screen", "serum",
    "plasma", "total", "normal", "range", "ranges", "what", "mean", "means", "your", "the", "and", "for", "with", "this", "that", "measure",
    "measures", "urine", "urinary",
)
CONTENT_STOPWORDS = tuple(
    "about above after again against also your yours their there these those them been being both cannot could does doing done down during "
    "each else even ever every from further have having here hers herself himself into itself just like made make many more most much must "
    "only other over same should some such than that the then this through under until very what when where which while will with within "
    "without would".split()
)
QUANTITY = r"(?<![A-Za-z0-9])(?<![A-Za-z]-)\d[\d,]*(?:\.\d+)?(?![A-Za-z0-9])"
LIFESTYLE_UNIT = r"(?:minute|min|hour|hr|day|daily|week|weekly|month|glass|cup|litre|liter|pint|portion|serving|piece|step|night|session|time|unit)(?:es|s)?\b"
DASHES = "‐‑‒–—"
MOST_WORDS, MOST_MAGNITUDE = 8, 1e15


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str, chars: str = r"\s") -> Column:
    """Without characters of the class ``chars`` at both ends."""
    for name, own in ((r"\s", " \t\n\x0b\f\r"), (r"\t", "\t"), (r"\-", "-")):
        chars = chars.replace(name, own)
    return F.btrim(_c(c), F.lit(chars))


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def number(c: Column | str) -> Column:
    """The number that a text consists of, or null."""
    return F.regexp_extract(_c(c), r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\s*$", 1).try_cast("double")


def alias_key(name: Column | str) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return strip(F.regexp_replace(F.lower(_c(name)), "[^a-z0-9]+", "_"), "_")


def _as_id(c: Column) -> Column:
    return strip(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), "_")


def canonical_name(name: Column | str) -> Column:
    """A stable id made of a name without words on how the sample was taken; UNKNOWN_TEST if nothing is left."""
    name = _c(name)
    noted = F.regexp_replace(name, IN_SPECIMEN, " ")
    bare = _as_id(F.regexp_replace(noted, QUALIFIERS, " "))
    kept = F.when(bare.isin("RBC", "WBC") & name.rlike(URINE_WORD), _as_id(noted)).otherwise(bare)
    return F.coalesce(or_null(kept), F.lit("UNKNOWN_TEST"))


def match_form(c: Column | str) -> Column:
    """Without parentheses, lower case, words of a-z and 0-9 with one space between."""
    bare = F.lower(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\(.*?\)", ""))
    return strip(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9\s]", " "), r"\s+", " "))


def clean_text(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.translate(_c(c), " ’", " '"), r"\s+", " "))


def plain_dashes(c: Column | str) -> Column:
    return F.translate(_c(c), DASHES, "-" * len(DASHES))


def clean_value(value: Column | str) -> Column:
    """Struct of the value without flag and marker, and the flag (H or L) or null."""
    unmarked = F.regexp_replace(F.coalesce(_c(value), F.lit("")), TRAILING_MARK, "")
    apart = strip(F.regexp_replace(unmarked, FLAG, " "))
    glued = apart.rlike(r"^[HL]\d")
    flag = F.coalesce(or_null(F.regexp_extract(unmarked, FLAG, 1)), F.when(glued, F.substring(apart, 1, 1)))
    return F.struct(F.when(glued, F.substring(apart, 2, 1 << 30)).otherwise(apart).alias("value"), flag.alias("flag"))


def split_name_flag(name: Column | str) -> Column:
    """Struct of the name without a flag at its end, and the flag or null."""
    name = _c(name)
    flag = or_null(F.regexp_extract(name, r"\s+([HL])$", 1))
    return F.struct(F.when(flag.isNotNull(), strip(F.regexp_replace(name, r"\s+[HL]$", ""))).otherwise(name).alias("name"), flag.alias("flag"))


def strip_footer(c: Column | str) -> Column:
    c = F.coalesce(_c(c), F.lit(""))
    some = reduce(or_, (F.contains(F.lower(c), F.lit(w)) for w in FOOTER_HAS))  # without any of these the pattern has no match
    return strip(F.when(some, F.regexp_replace(c, FOOTER, "")).otherwise(c))


def clean_unit(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"^[A-Za-z]\s*\n\s*", "")


def split_unit_range(unit: Column | str, ref_range: Column | str) -> Column:
    """Struct of unit and ref_range; a range inside the unit cell takes the place of ref_range."""
    unit, swallowed = _c(unit), _c(unit).rlike(UNIT_WITH_RANGE)
    return F.struct(
        F.when(swallowed, F.regexp_extract(unit, UNIT_WITH_RANGE, 1)).otherwise(unit).alias("unit"),
        F.when(swallowed, F.regexp_extract(unit, UNIT_WITH_RANGE, 2)).otherwise(_c(ref_range)).alias("ref_range"),
    )


def is_test_name(name: Column | str) -> Column:
    name = strip(F.coalesce(_c(name), F.lit("")))
    return (F.length(name) >= 2) & name.rlike("[A-Za-z]{2}") & ~name.rlike(NOT_A_TEST) & (F.size(F.split(name, r"\s+")) <= MOST_WORDS)


def unglue_name(name: Column | str) -> Column:
    """Drop first lines as long as they are no test name and the rest is one."""
    lines = F.split(_c(name), "\n")

    def drop(state: Column, _: Column) -> Column:
        rest = strip(F.array_join(F.slice(F.split(state["name"], "\n"), 2, 1 << 30), "\n"))
        go = ~state["done"] & F.contains(state["name"], F.lit("\n")) & ~is_test_name(F.get(F.split(state["name"], "\n"), F.lit(0))) & is_test_name(rest)
        return F.struct(F.when(go, rest).otherwise(state["name"]).alias("name"), (~go).alias("done"))

    whole = F.aggregate(lines, F.struct(_c(name).alias("name"), F.lit(False).alias("done")), drop, lambda s: s["name"])
    return F.when(F.contains(_c(name), F.lit("\n")), whole).otherwise(_c(name))


def clean_categorical(c: Column | str) -> Column:
    return strip(strip(strip(c), "\"'"))


def is_result_value(value: Column | str, name: Column | str) -> Column:
    value, token = _c(value), clean_categorical(value)
    plain = value.rlike(r"^-?\d+\.?\d*$")
    letters = (F.length(token) > 0) & (F.length(token) <= 4) & F.replace(token, F.lit(" "), F.lit("")).rlike(r"^\p{L}+$")
    return (
        F.when(F.coalesce(value, F.lit("")) == "", False)
        .when(plain, F.abs(value.try_cast("double")) <= MOST_MAGNITUDE)
        .otherwise(value.rlike(COUNT_RANGE) | F.lower(value).isin(*QUALITATIVE) | (_c(name).rlike(CATEGORICAL_NAME) & letters))
    )


def stored_value(value: Column | str, name: Column | str) -> Column:
    """The upper end of a small count range, a blood group without quotes, else the value."""
    value = _c(value)
    return F.when(value.rlike(COUNT_RANGE), F.regexp_extract(value, COUNT_RANGE, 2)).when(_c(name).rlike(CATEGORICAL_NAME), clean_categorical(value)).otherwise(value)


def page_specimen(text: Column | str) -> Column:
    return F.when(_c(text).rlike(URINE_SECTION), "urine")


def tokens(c: Column | str, least: int, stopwords: tuple[str, ...]) -> Column:
    """Distinct lower-case words of ``least`` letters or more, one s at the end dropped, without stopwords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    return F.array_except(F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, "s$", ""))), F.array(*map(F.lit, stopwords)))


def anchor_tokens(c: Column | str) -> Column:
    return tokens(c, 3, ANCHOR_STOPWORDS)


def content_tokens(c: Column | str) -> Column:
    return tokens(c, 4, CONTENT_STOPWORDS)


def _numbers(found: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull()))


def numbers_in(c: Column | str) -> Column:
    """Distinct quantities that stand alone: next to no letter or digit; thousands commas are dropped."""
    return _numbers(F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(QUANTITY), F.lit(0)))


def lifestyle_numbers_in(c: Column | str) -> Column:
    """Distinct quantities with a unit of everyday habits, one or both ends of a range."""
    n = r"(\d[\d,]*(?:\.\d+)?)"
    c = F.coalesce(_c(c), F.lit(""))
    either = rf"(?i)(?:{n}\s*(?:[-–—]|to)\s*{n}\s*{LIFESTYLE_UNIT}|{n}\s*(?:a\s+|per\s+)?{LIFESTYLE_UNIT})"
    groups = [F.regexp_extract_all(c, F.lit(either), F.lit(k)) for k in (1, 2, 3)]
    return _numbers(F.filter(F.concat(*groups), lambda x: x.isNotNull() & (x != "")))


def json_text(c: Column | str) -> Column:
    """From the first opening to the last closing brace of a generator's answer; {} if there are none."""
    return F.coalesce(or_null(F.regexp_extract(F.regexp_replace(_c(c), r"```(?:json)?", ""), r"(?s)\{.*\}", 0)), F.lit("{}"))


def coerce_details(c: Column | str) -> Column:
    """Struct of what_it_measures, lifestyle_suggestions, gp_question, disclaimer from JSON; blanks and other types are null."""
    c = _c(c)
    obj = F.from_json(json_text(c), "struct<what_it_measures string, lifestyle_suggestions string, gp_question string, disclaimer string>")
    said = lambda k: or_null(strip(obj[k]))
    listed = F.from_json(obj["lifestyle_suggestions"], "array<string>")
    lines = F.filter(F.transform(F.split(obj["lifestyle_suggestions"], r"\r?\n"), lambda p: strip(p, r" \-*•\t")), lambda p: p != "")
    alone = F.when(F.size(lines) > 1, lines).otherwise(F.array(strip(obj["lifestyle_suggestions"])))
    several = F.filter(F.transform(F.when(obj["lifestyle_suggestions"].rlike(r"^\s*\["), listed).otherwise(alone), lambda p: strip(p)), lambda p: p != "")
    return F.struct(said("what_it_measures").alias("what_it_measures"), F.when(F.size(several) > 0, several).alias("lifestyle_suggestions"), said("gp_question").alias("gp_question"), said("disclaimer").alias("disclaimer"))


# Fixed value.
GENERIC_TITLE_WORDS = r"(?i)\b(tumor\s*marker\s*test|blood\s*tests?|screening\s*tests?|test|tests|screening|panel|levels?)\b"


def derive_test_ids(title: Column | str) -> Column:
    """Ids of a page's title: each short parenthetical, then the title without them and generic words."""
    title = _c(title)
    inside = F.transform(F.regexp_extract_all(title, F.lit(r"\(([A-Za-z0-9\-/ ]{2,15})\)"), F.lit(1)), canonical_name)
    bare = F.regexp_replace(F.regexp_replace(title, r"\([^)]*\)", " "), GENERIC_TITLE_WORDS, " ")
    ids = F.filter(F.array_distinct(F.concat(inside, F.array(canonical_name(bare)))), lambda x: x != "UNKNOWN_TEST")
    return F.when(F.size(ids) > 0, ids).otherwise(F.array(canonical_name(title)))


def stub_name(test_id: Column | str) -> Column:
    """An id as a name: each run of letters begins with a capital, also after digits."""
    runs = F.regexp_extract_all(F.lower(F.replace(_c(test_id), F.lit("_"), F.lit(" "))), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")


def patient_text(wim: Column | str, suggestions: Column | str, question: Column | str) -> Column:
    filled = lambda c: or_null(F.coalesce(c, F.lit("")))
    return F.concat_ws(" ", filled(_c(wim)), filled(F.array_join(_c(suggestions), " ")), filled(_c(question)))


def is_complete(wim: Column | str, suggestions: Column | str, question: Column | str) -> Column:
    filled = lambda c: strip(F.coalesce(_c(c), F.lit(""))) != ""
    return filled(wim) & (F.coalesce(F.size(_c(suggestions)), F.lit(0)) >= 2) & filled(question)


def readability(c: Column | str) -> Column:
    """Struct of words, sentences, syllables (groups of vowels, one to a word at least), grade and reading ease."""
    c = F.lower(F.coalesce(_c(c), F.lit("")))
    words = F.size(F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0)))
    sentences = F.greatest(F.size(F.regexp_extract_all(c, F.lit("[.!?]+"), F.lit(0))), F.lit(1))
    syllables = F.greatest(F.size(F.regexp_extract_all(c, F.lit("[aeiouy]+"), F.lit(0))), words)
    some = words > 0
    grade = F.when(some, 0.39 * words / sentences + 11.8 * syllables / words - 15.59)
    ease = F.when(some, 206.835 - 1.015 * words / sentences - 84.6 * syllables / words)
    return F.struct(words.alias("words"), sentences.alias("sentences"), syllables.alias("syllables"), grade.alias("grade"), ease.alias("ease"))
