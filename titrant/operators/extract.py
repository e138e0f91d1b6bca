"""Result rows out of table grids, positioned words and text lines, for many reports at once.

Inputs: grids (doc_id, page, table_no, row_no, cells), words (doc_id, page, text, x0, x1, top, upright, page_width), lines
(doc_id, line_no, line). Every operator groups by document, page or table, so work spreads over reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import on_boundary
from ..functions.text import (
    clean_unit, clean_value, is_result_value, is_test_name, page_specimen, split_name_flag, split_unit_range,
    stored_value, strip, strip_footer, unglue_name,
)
from ..sources.kept import let, settled
from .dims import resolve
from .results import dedupe, first_wins

# Fixed values.
HEAD = {
    "test": ("test", "observation", "investigation", "parameter", "analyte"),
    "result": ("result", "value", "observed"),
    "unit": ("unit",),
    "ref": ("ref", "biological", "interval", "normal range", "range"),
}
REF_STARTS = ("biological", "ref", "interval", "normal", "range")
HEADER_ROWS, ROW_POINTS, COLUMN_POINTS, LEAST_LINE, LEAST_ROWS, LEAST_TEXT = 40, 2.5, 6.0, 4, 3, 30
NAMED, SPELT, UNIT, NUMBER = r"A-Za-z0-9\s()/-", r"A-Za-z\s()/-", r"a-zA-Z0-9/%^", r"[\d.]++"
# What these match, with groups for name, value and unit, is fixed: a name with a colon, a name of 2 to 31 characters before wide
# space, a name before a tab. They look from the beginning of a run of name characters only, and take runs whole.
LINE_PATTERNS = (
    rf"(?<![{NAMED}])[0-9\s()/-]*+([A-Za-z][{NAMED}]++):\s*+({NUMBER})\s*+([{UNIT}µuμ*]++)?",
    rf"([A-Za-z][{SPELT}]{{1,30}}?)\s{{2,}}+({NUMBER})\s*+([{UNIT}]++)?",
    rf"(?<![{NAMED}])[0-9\s()/-]*+([A-Za-z][{NAMED}]+)\t({NUMBER})\s*+([{UNIT}]++)?",
)
WIDEST = 34  # white space beyond this changes no match of the second pattern, whose names are shorter
PAGE_MARK = r"(?i)^-{3}\s*PAGE\s+(\d+)\s*-{3}$"
CELL_NAME = r"^[A-Za-z][A-Za-z0-9\s\(\)\/\-]{1,40}$"
CELL_VALUE = r"^([\d.]+)\s*([a-zA-Z0-9/%µuμ\^]*)$"


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("(" + "|".join(words) + ")")


def is_header(joined: Column) -> Column:
    """Whether lower-case text names a test column and a result or reference column."""
    return _any_in(joined, HEAD["test"]) & (_any_in(joined, HEAD["result"]) | _any_in(joined, HEAD["ref"]))


def build_rows(cells: DataFrame) -> DataFrame:
    """``cells`` (raw_name, value, unit, ref_range as printed, any other columns) with accepted and the cleaned columns."""
    out = cells.withColumn("raw_name", unglue_name(strip(F.coalesce("raw_name", F.lit("")), " .:-")))
    out = out.withColumns({"_v": clean_value("value"), "_n": split_name_flag("raw_name")})
    out = out.withColumns({"raw_name": F.col("_n.name"), "value": F.col("_v.value"), "flag": F.coalesce("_v.flag", "_n.flag")})
    out = out.withColumn("accepted", is_test_name("raw_name") & is_result_value("value", "raw_name"))
    out = out.withColumns({"value": stored_value("value", "raw_name"), "_u": split_unit_range(clean_unit(strip_footer("unit")), strip_footer("ref_range"))})
    return out.withColumns({"unit": F.col("_u.unit"), "ref_range": F.nullif("_u.ref_range", F.lit(""))}).drop("_v", "_n", "_u")


def glue_header_tables(grids: DataFrame) -> DataFrame:
    """Put a table of one header row in front of the next table of its page; one without a next table is left out.

    Of several such tables in a row every second one is put in front of the one after it, which then is no header alone."""
    table = ["doc_id", "page", "table_no"]
    order = Window.partitionBy("doc_id", "page").orderBy("table_no", "row_no")
    alone = F.count(F.lit(1)).over(Window.partitionBy(*table)) == 1
    head = F.when(F.col("_alone") & F.col("row_no").isNotNull(), is_header(F.lower(F.array_join("cells", " ", ""))))
    rows = settled(grids.withColumn("_alone", alone)).withColumn("_head", F.coalesce(head, F.lit(False)))
    # A header alone is one row: the next row is the next table's first, and its place among headers in a row is its distance
    # from the last row that is none.
    rows = rows.withColumns({"_next": F.lead("table_no").over(order), "_at": F.row_number().over(order)})
    rows = rows.withColumn("_before", F.coalesce(F.max(F.when(~F.col("_head"), F.col("_at"))).over(order), F.lit(0)))
    named = F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.col("table_no").isNotNull()
    rows = rows.withColumn("_moved", F.col("_head") & ((F.col("_at") - F.col("_before")) % 2 == 1) & named).where("not _moved or _next is not null")
    glued = {"row_no": F.when(F.col("_moved"), F.lit(-1)).otherwise(F.col("row_no")), "table_no": F.when(F.col("_moved"), F.col("_next")).otherwise(F.col("table_no"))}
    return rows.withColumns(glued).select(*grids.columns)


def grid_rows(grids: DataFrame) -> DataFrame:
    """Accepted rows of tables whose header names a test and a result column; the header is the first of 40 rows."""
    table = ["doc_id", "page", "table_no"]
    at = F.row_number().over(Window.partitionBy(*table).orderBy("row_no")) - 1
    joined = F.regexp_replace(F.lower(F.array_join("cells", " ", "")), r"\s+", " ")
    rows = grids.withColumn("_at", at).withColumn("_h", (F.col("_at") < HEADER_ROWS) & is_header(joined))
    cells = F.transform("cells", lambda c: F.lower(strip(F.coalesce(c, F.lit("")))))
    first_with = lambda cells, words: F.array_position(F.transform(cells, lambda c: _any_in(c, words)), True) - 1
    # Columns are looked for in header rows alone, not again for each row under them.
    head = let(cells, lambda x: F.struct("_at", *(first_with(x, words).alias(f"_{role}") for role, words in HEAD.items())))
    rows = rows.withColumn("_head", F.min(F.when(F.col("_h"), head)).over(Window.partitionBy(*table)))
    rows = rows.where("_head is not null and _at > _head._at and _head._test >= 0 and _head._result >= 0")
    rows = rows.select("*", *(f"_head._{role}" for role in HEAD))
    cell = lambda role: F.when(F.col(f"_{role}") >= 0, F.coalesce(F.get("cells", F.col(f"_{role}")), F.lit(""))).otherwise("")
    rows = rows.withColumns({"raw_name": cell("test"), "value": cell("result"), "unit": cell("unit"), "ref_range": cell("ref")})
    seq = F.struct(F.lit(0).alias("tier"), "page", F.col("table_no").cast("long").alias("a"), F.col("_at").cast("long").alias("b"))
    rows = settled(rows.select("doc_id", "page", seq.alias("seq"), "raw_name", "value", "unit", "ref_range")).where("raw_name != ''")
    return settled(build_rows(rows)).where("accepted").select("doc_id", "page", "seq", "raw_name", "value", "unit", "ref_range", "flag")


def visual_lines(words: DataFrame) -> DataFrame:
    """doc_id, page, line, words (x0, x1, text from left to right): words within 2.5 points of height."""
    inside = words.where(F.col("upright") & (F.col("x0") >= 0) & (F.col("x1") <= F.col("page_width")))
    inside = inside.withColumn("line", F.rint(F.col("top") / ROW_POINTS).cast("long"))
    return inside.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("words"))


def header_columns(words: Column | str) -> Column:
    """Array of (x, role) by x if the words are a column header with a test and a result column, else null."""
    words = F.col(words) if isinstance(words, str) else words
    said = F.lower(F.array_join(F.transform(words, lambda w: w["text"]), " "))

    def role(token: Column) -> Column:
        starts = lambda some: token.rlike("^(" + "|".join(some) + ")")
        return F.when(starts(HEAD["test"]), "test").when(starts(HEAD["result"]), "result").when(starts(HEAD["unit"]), "unit").when(starts(REF_STARTS), "ref")

    def columns(marked: Column) -> Column:
        first = lambda r: F.get(F.filter(marked, lambda m: m["role"] == r), F.lit(0))
        return F.array_sort(F.filter(F.array(*map(first, HEAD)), lambda m: m.isNotNull()))

    tokens = F.transform(words, lambda w: F.struct(w["x0"].alias("x"), strip(F.lower(w["text"]), ".:()").alias("token")))
    marked = F.filter(F.transform(tokens, lambda w: F.struct(w["x"].alias("x"), role(w["token"]).alias("role"))), lambda m: m["role"].isNotNull())
    has = lambda cols, r: F.exists(cols, lambda m: m["role"] == r)
    # Few lines are headers, and only of these the columns are worked out, once.
    return F.when(is_header(said), let(let(marked, columns), lambda cols: F.when(has(cols, "test") & has(cols, "result"), cols)))


def column_of(middle: Column, columns: Column) -> Column:
    """Role of the last column that starts at or left of a word's middle, with some slack; else the first column's."""
    left = F.filter(columns, lambda c: c["x"] <= middle + COLUMN_POINTS)
    return F.coalesce(F.try_element_at(left, F.lit(-1))["role"], F.get(columns, F.lit(0))["role"])


def columnar_rows(words: DataFrame) -> DataFrame:
    """Accepted rows of whitespace-aligned pages. A header line holds until the next; a line without a result that follows
    an accepted row and shows band text is added to that row's range."""
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    lines = visual_lines(words).withColumn("_own", header_columns("words"))
    lines = lines.withColumn("_cols", F.last("_own", ignorenulls=True).over(order)).where("_own is null and _cols is not null")

    lines = lines.withColumn("words", F.transform("words", lambda w: F.struct(column_of((w["x0"] + w["x1"]) / 2, F.col("_cols")).alias("role"), w["text"].alias("text"))))

    def cell(role: str) -> Column:
        return strip(F.array_join(F.transform(F.filter("words", lambda w: w["role"] == role), lambda w: w["text"]), " "))

    cells = lines.withColumns({"raw_name": cell("test"), "value": cell("result"), "unit": cell("unit"), "ref_range": cell("ref")})
    cells = cells.drop("words", "_own", "_cols").withColumns({"_blank": F.col("value") == "", "_more": strip_footer("ref_range")})
    seq = F.struct(F.lit(1).alias("tier"), "page", F.col("line").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    rows = build_rows(cells).withColumns({"seq": seq, "_row": F.sum(F.col("accepted").cast("long")).over(order)}).where("_row > 0")
    more = F.when(~F.col("accepted") & F.col("_blank") & F.col("_more").rlike(r"[<>:]|\d"), F.struct("line", "_more"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(more)), lambda x: x["_more"]), " ")
    island = rows.groupBy("doc_id", "page", "_row").agg(whole.alias("_rest"), *(F.max(F.when(F.col("accepted"), F.col(c))).alias(c) for c in ("seq", "raw_name", "value", "unit", "ref_range", "flag")))
    joined = strip(F.concat_ws(" ", F.coalesce("ref_range", F.lit("")), "_rest"))
    return island.withColumn("ref_range", F.nullif(joined, F.lit(""))).drop("_row", "_rest")


def with_specimen(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows with specimen of their page. ``pages``: doc_id, page, text."""
    found = pages.groupBy("doc_id", "page").agg(F.max(page_specimen("text")).alias("specimen"))
    return rows.join(found, ["doc_id", "page"], "left")


def structured_tables(grids: DataFrame, words: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tier 1: rows of grids, and of positioned words on pages without a grid, deduplicated. A header that no table of its
    page follows is no grid."""
    glued = glue_header_tables(grids)
    ruled = glued.select("doc_id", "page").distinct()
    rows = grid_rows(glued).unionByName(columnar_rows(words).join(ruled, ["doc_id", "page"], "left_anti"))
    return dedupe(resolve(with_specimen(rows, pages), aliases), within=("doc_id",))


def report_text(layer: Column | str, read: Column | str, mode: str = "auto") -> Column:
    """Struct text, ocr: the text layer, or what was read from the page images where the layer has fewer than ``LEAST_TEXT``
    characters or ``mode`` is ocr, and there is something to read."""
    layer, read = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (layer, read))
    wanted = F.lit(True) if mode == "ocr" else F.length(strip(layer)) < LEAST_TEXT
    ocr = wanted & (strip(read) != "")
    return F.struct(F.when(ocr, read).otherwise(layer).alias("text"), ocr.alias("ocr"))


def carry_page(lines: DataFrame) -> DataFrame:
    """Lines without page markers, each with the number of the last marker before it (0: none)."""
    mark = F.nullif(F.regexp_extract(strip("line"), PAGE_MARK, 1), F.lit("")).cast("long")
    page = F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no")), F.lit(0))
    return lines.withColumns({"page": page, "_mark": mark}).where("_mark is null").drop("_mark")


def pipe_row(line: Column | str) -> Column:
    """Struct name, value, unit of a markdown table row: the first cell like a name, the first later one like a value."""
    line = F.col(line) if isinstance(line, str) else line
    cells = F.filter(F.transform(F.split(strip(line, "|"), r"\|"), lambda c: strip(c)), lambda c: (c != "") & ~c.rlike("^-{2,}$"))
    at = F.array_position(F.transform(cells, lambda c: c.rlike(CELL_NAME)), True)
    good = lambda c: c.rlike(CELL_VALUE) & F.regexp_extract(c, CELL_VALUE, 1).try_cast("double").isNotNull()
    found = F.get(F.filter(F.slice(cells, F.greatest(at + 1, F.lit(1)).cast("int"), 1 << 30), good), F.lit(0))
    return F.when((at > 0) & found.isNotNull(), F.struct(F.get(cells, (at - 1).cast("int")).alias("raw_name"), F.regexp_extract(found, CELL_VALUE, 1).alias("value"), F.regexp_extract(found, CELL_VALUE, 2).alias("unit")))


def line_groups(line: Column) -> list[Column]:
    """For each line pattern the three groups of its first match with marks between them, found at once in time that grows with
    the line; no marks if there is none."""
    narrow = F.when(line.rlike(rf"\s{{{WIDEST}}}"), F.regexp_replace(line, rf"(\s{{{WIDEST}}})\s++", "$1")).otherwise(line)
    return [F.regexp_replace(of, f"^(?s:.*?){p}(?s:.*)$", "$1\x01$2\x01$3") for of, p in zip((line, narrow, line), LINE_PATTERNS, strict=True)]


def pattern_row(line: Column | str) -> Column:
    """Struct name, value, unit of the first line pattern with a number."""
    line = F.col(line) if isinstance(line, str) else line
    return F.coalesce(*(_found(F.split(g, "\x01")) for g in line_groups(line)))


def _found(groups: Column) -> Column:
    value = F.get(groups, F.lit(1))
    return F.when(value.try_cast("double").isNotNull(), F.struct(strip(F.get(groups, F.lit(0))).alias("raw_name"), value.alias("value"), F.get(groups, F.lit(2)).alias("unit")))


def text_rows(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Regex tier: rows of text lines, the first of each id in a document."""
    rows = settled(carry_page(lines).select("doc_id", "page", "line_no", strip("line").alias("line"))).where(F.length("line") >= LEAST_LINE)
    piped = F.startswith("line", F.lit("|"))
    rows = rows.withColumns({f"_g{k}": F.when(~piped, F.split(g, "\x01")) for k, g in enumerate(line_groups(F.col("line")))})
    rows = settled(rows.withColumn("_r", F.when(piped, pipe_row("line")).otherwise(F.coalesce(*(_found(F.col(f"_g{k}")) for k in range(len(LINE_PATTERNS))))))).where("_r is not null")
    rows = rows.select("doc_id", "page", F.struct(F.lit(2).alias("tier"), "page", F.col("line_no").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("seq"), "_r.*")
    return first_wins(resolve(rows, aliases), ["doc_id", "test_id"], "seq").withColumns({"ref_range": F.lit(None).cast("string"), "flag": F.lit(None).cast("string")})


def clean_extracted(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows a generator extracted (doc_id, seq, raw_name, value, unit, ref_range, status): trimmed, named, with needs_review."""
    out = rows.withColumns({c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("raw_name", "value", "unit")}).where("raw_name != '' and value != ''")
    out = out.withColumns({"ref_range": F.nullif(strip(F.coalesce("ref_range", F.lit(""))), F.lit("")), "status": F.lower(strip(F.coalesce("status", F.lit("unknown"))))})
    return resolve(out, aliases).withColumn("needs_review", on_boundary("value", F.coalesce("ref_range", F.lit(""))))


def cascade(tables: DataFrame, extracted: DataFrame, text: DataFrame, docs: DataFrame, mode: str = "auto") -> DataFrame:
    """Rows of each document by the cheapest tier that suffices, with ``method``.

    docs: doc_id and, where known, ocr (whether the text was read from images) and tier (vision or llm_text: the tier that
    answered, also where none of its rows is left after verification; else null). Without these columns documents have a
    text layer, and a tier vision where ``extracted`` has rows.

    Tables alone with ``LEAST_ROWS`` rows or more; else, where a tier answered, its rows with the table's, if there are any;
    else text rows with the table's; a document without any row has one with method manual_required and no id. Modes regex
    and ocr take text rows alone. Methods of tiers that used text read from images begin with ocr_.
    """
    gate = docs.groupBy("doc_id").agg(*(F.max(c).alias(f"_{c}") if c in docs.columns else F.lit(None).cast(t).alias(f"_{c}") for c, t in (("ocr", "boolean"), ("tier", "string"))))
    tagged = [rows.withColumn("_from", F.lit(name)) for rows, name in ((tables, "tables"), (extracted, "tier"), (text, "text"))]
    every = tagged[0].unionByName(tagged[1], allowMissingColumns=True).unionByName(tagged[2], allowMissingColumns=True)
    columns = [c for c in every.columns if c not in ("doc_id", "_from")]
    # A document's rows are counted where they are, by a window over the report, so that no tier is worked out twice.
    own = Window.partitionBy("doc_id")
    rows = gate.join(every, "doc_id", "left").withColumns({f"_n_{k}": F.count_if(F.col("_from") == k).over(own) for k in ("tables", "tier", "text")})
    read = F.when(F.coalesce("_ocr", F.lit(False)), "ocr_").otherwise("")
    tier = F.coalesce("_tier", F.when(F.col("_n_tier") > 0, "vision"))
    some, texts = F.col("_n_tables") > 0, F.col("_n_text") > 0
    if mode in ("regex", "ocr"):
        source, taken = F.when(texts, "text"), F.col("_from") == "text"
    else:
        source = F.when(F.col("_n_tables") >= LEAST_ROWS, "tables").when(tier.isNotNull() & ((F.col("_n_tier") > 0) | some), "tier").when(texts | some, "text")
        taken = (F.col("_from") == "tables") | (F.col("_from") == F.col("_source"))
    named = F.when(F.col("_source") == "tables", "table_structured").when(F.col("_source") == "tier", F.concat(F.when(tier.contains("ocr"), "").otherwise(read), tier)).when(F.col("_source") == "text", F.concat(read, F.lit("structured")))
    rows = rows.withColumn("_source", source)
    first = F.row_number().over(own.orderBy(F.col("_from").asc_nulls_last()))
    rows = rows.withColumns({"method": F.coalesce(named, F.lit("manual_required")), "_one": F.when(F.col("_source").isNull(), first)})
    rows = rows.where((F.col("_source").isNotNull() & taken) | (F.col("_one") == 1))
    rows = rows.select("doc_id", *(F.when(F.col("_source").isNotNull(), F.col(c)).alias(c) for c in columns), "method")
    return dedupe(rows, within=("doc_id",))


def manual_rows(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows a user typed (raw_name, value, unit): trimmed, blank ones dropped, resolved, without printed range."""
    out = entries.withColumn("raw_name", strip(F.coalesce("raw_name", F.lit("")))).where("raw_name != '' and value is not null")
    return resolve(out, aliases).withColumns({"ref_range": F.lit(None).cast("string"), "status": F.lit(None).cast("string")})


