"""Printed reference ranges as bounds, and the status of a value against them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number, strip

# Fixed values.
RANGE = r"(-?\d+\.?\d*)\s*%?\s*-\s*(-?\d+\.?\d*)\s*%?"
BELOW = r"[<≤]\s*(-?\d+\.?\d*)"
ABOVE = r"[>≥]\s*(-?\d+\.?\d*)"
STRAY_POINT = r"(\d)\s+\.\s*(\d)"
BAND = r"([A-Za-z][A-Za-z \-/]{1,40}?)\s*:\s*([^:]*?)(?=(?:[A-Za-z][A-Za-z \-/]{1,40}?\s*:)|$)"
HEALTHY = (
    "desirable", "normal", "optimal", "sufficiency", "negative", "non-reactive", "non reactive", "non-diabetes", "non diabetes",
    "not diabetic", "good control", "within normal",
)
NORMAL_WORDS = ("negative", "nil", "clear", "absent", "normal", "pale yellow", "straw")
HIGH_WORDS = ("positive", "1+", "2+", "3+", "4+", "reactive", "cloudy", "present", "detected")
STATUSES = ("low", "normal", "high", "unknown")
BLOOD_TYPES = ("ABO_TYPE", "RH_D_TYPE")
SAME = 1e-9

BOUNDS = "struct<lo:double,hi:double>"
HEALTHY_LABEL = r"\b(" + "|".join(HEALTHY) + r")\b"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def _bounds(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def plain_bounds(text: Column) -> Column:
    """The first pair, else upper, else lower bound that a text shows; null if it shows none."""
    none = F.lit(None).cast("double")
    shows = lambda pattern: F.regexp_extract(text, pattern, 1) != ""
    return (
        F.when(shows(RANGE), _bounds(_first(text, RANGE), _first(text, RANGE, 2)))
        .when(shows(BELOW), _bounds(none, _first(text, BELOW)))
        .when(shows(ABOVE), _bounds(_first(text, ABOVE), none))
    )


def parse_range(text: Column | str) -> Column:
    """Struct lo, hi (null: open) of a printed range, or null if the text has none.

    Of two or more labelled bands the first with a healthy label counts; bands labelled low and high alone give the end of
    the low band as lower bound; otherwise the plain forms count.
    """
    text = F.col(text) if isinstance(text, str) else text
    clean = F.regexp_replace(strip(text), STRAY_POINT, "$1.$2")
    # A band has its label before its one colon, which no label holds, and the rest is its part: one match gives both.
    found = F.regexp_extract_all(clean, F.lit(BAND), F.lit(0))
    bands = F.transform(found, lambda m: F.struct(F.lower(strip(F.substring_index(m, ":", 1))).alias("label"), F.regexp_replace(F.substring_index(m, ":", -1), r"^\s+", "").alias("part")))
    banded = F.get(F.transform(F.array(bands), _from_bands), F.lit(0))  # the bands are found once
    return F.when(strip(text) != "", F.coalesce(F.when(clean.like("%:%:%"), banded), plain_bounds(clean)))  # two bands have two colons


def _from_bands(bands: Column) -> Column:
    parsed = F.filter(F.transform(bands, lambda b: F.when(b["label"].rlike(HEALTHY_LABEL), plain_bounds(b["part"]))), lambda x: x.isNotNull())
    healthy = F.when(F.size(bands) >= 2, F.get(parsed, F.lit(0)))
    low = F.get(F.filter(bands, lambda b: b["label"] == "low"), F.lit(0))["part"]
    both = (F.size(bands) == 2) & (F.array_sort(F.transform(bands, lambda b: b["label"])) == F.array(F.lit("high"), F.lit("low")))
    low_end = F.coalesce(_first(low, BELOW), _first(low, RANGE))
    return F.coalesce(healthy, F.when(both & low_end.isNotNull(), _bounds(low_end, F.lit(None))))


def on_boundary(value: Column | str, ref_range: Column | str) -> Column:
    """Whether a numeric value equals a number printed in its range, so that the row wants a review."""
    v = number(value)
    shown = F.transform(F.regexp_extract_all(ref_range if isinstance(ref_range, Column) else F.col(ref_range), F.lit(r"-?\d+\.?\d*"), F.lit(0)), lambda x: x.try_cast("double"))
    return F.coalesce(F.exists(shown, lambda x: F.abs(x - v) < SAME), F.lit(False))


def _against(v: Column, lo: Column, hi: Column) -> Column:
    sure = ~F.isnan(v)  # a value that is not a number is on neither side
    return F.when(sure & (v < lo), "low").when(sure & (v > hi), "high").otherwise("normal")


def status(value: Column | str, printed: Column, lo: Column, hi: Column, guess: Column) -> Column:
    """low, normal, high or unknown: by the printed bounds, else the static ones, else the guess, else by words."""

    def of(read: Column) -> Column:
        v, word = read["v"], read["word"]
        return (
            F.when(printed.isNotNull() & v.isNotNull(), _against(v, printed["lo"], printed["hi"]))
            .when(v.isNotNull() & (lo.isNotNull() | hi.isNotNull()), _against(v, lo, hi))
            .when(guess.isin(*STATUSES), guess)
            .when(word.isin(*NORMAL_WORDS), "normal")
            .when(word.isin(*HIGH_WORDS), "high")
            .otherwise("unknown")
        )

    read = F.struct(number(value).alias("v"), F.lower(strip(value)).alias("word"))
    return F.get(F.transform(F.array(read), of), F.lit(0))  # the value is read once
