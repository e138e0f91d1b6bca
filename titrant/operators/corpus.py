"""Reference corpus: pages to sections to chunks, link discovery, chunk and index tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, derive_test_ids, strip
from ..sources.kept import fewer_arrow_rows, let
from .results import fingerprint, first_wins

MOST_CHARS, LEAST_CHARS = 1100, 120

# Fixed values.
SKIPPED_HEADING = (
    r"(?i)(are there any risks|what happens during|how (is|do) .*(test|it) (work|done)|do i need to do anything to prepare|"
    r"will i need to do anything to prepare|references|related (health )?topics|learn more|more information|see also|sources|"
    r"find a (test|clinic)|about this|patient handouts)"
)
BOILERPLATE = (
    r"(?i)(page last reviewed|next review due|urac|health on the net|the information on this site should not be used|a\.d\.a\.m\.|copyright|"
    r"all rights reserved|cookies on the nhs|medlineplus links to health information|is the official website of|javascript)"
)
# Lower case, one of which is in whatever BOILERPLATE finds.
BOILERPLATE_HAS = (
    "page last reviewed", "next review due", "urac", "health on the net", "the information on this site should not be used", "a.d.a.m.", "copyright",
    "all rights reserved", "cookies on the nhs", "medlineplus links to health information", "is the official website of", "javascript",
)
STRIPPED_TAGS = ("script", "style", "nav", "aside", "footer", "header", "form", "noscript", "iframe", "button")
STRIPPED_CLASSES = (
    "mp-refs", "mp-share", "mp-related", "usa-banner", "breadcrumb", "nhsuk-breadcrumb", "nhsuk-contents-list", "nhsuk-pagination",
    "nhsuk-back-link", "page-feedback", "site-footer", "goog-te-banner-frame",
)
STRIPPED_IDS = ("mplus-links",)
LAB_TEST_LINK = r"^https://medlineplus\.gov/lab-tests/[a-z0-9\-]+/?$"
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
TEXT_TAGS = ("h1", "h2", "h3", "p", "li")
BARE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;|[0-9A-Za-z]+;)")  # begins no character reference that a semicolon ends
PAGES_AT_ONCE = 500  # that a worker is handed
TOLD_AT_ONCE = 1 << 20  # characters of texts that a worker holds before it hands them on


class _Page(HTMLParser):
    """A page as a small node tree in document order.

    Elements are numbered by their start tags; ``elements`` has the tag, the classes, the id and the number of the first element
    after it of each, ``events`` the numbers of elements as they start (from 1), their negatives as they end, and texts. An end
    tag ends all that was opened inside it; one that nothing open matches is ignored; nothing else ends an element.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = [["", (), None, 0]]  # the page itself
        self.events: list[int | str] = []
        self.hrefs: dict[int, str] = {}
        self.stack: list[int] = []
        self.open: Counter[str] = Counter()
        self.said: list[str] = []
        self.feed(html)
        self.close()
        self._told()
        while self.stack:
            self._end()
        self.elements[0][3] = len(self.elements)

    def _told(self) -> None:
        if self.said:
            self.events.append("".join(self.said))
            self.said = []

    def _end(self) -> str:
        at = self.stack.pop()
        self.elements[at][3] = len(self.elements)
        self.events.append(-at)
        self.open[self.elements[at][0]] -= 1
        return self.elements[at][0]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._told()
        got = {k: v or "" for k, v in attrs}
        self.elements.append([tag, got.get("class", "").split(), got.get("id"), 0])
        at = len(self.elements) - 1
        if "href" in got:
            self.hrefs[at] = got["href"]
        self.events.append(at)
        self.stack.append(at)
        self.open[tag] += 1
        if tag in VOID_TAGS:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        self._told()
        while self.open[tag] > 0 and self._end() != tag:
            pass

    def handle_data(self, data: str) -> None:
        self.said.append(data)

    def _mark(self, data: str) -> None:
        self._told()

    handle_comment = handle_decl = handle_pi = unknown_decl = _mark

    def first(self, fits: Callable[[list], bool]) -> int | None:
        return next((k for k, e in enumerate(self.elements) if k and fits(e)), None)

    def root(self) -> int:
        """The first element of the first kind of content root that the page has, also if it is empty; else the page."""
        kinds = [lambda e: e[0] == "div" and "main" in e[1], *(lambda e, t=t: e[0] == t for t in ("main", "article", "body"))]
        return next((k for k in map(self.first, kinds) if k is not None), 0)

    def texts(self, root: int, tags: tuple[str, ...], strip: bool = True) -> list[tuple[int, str, str]]:
        """(number, tag, text) of the elements below ``root`` with one of the tags, in document order; parts that are no content
        are left out, with all that is in them, where they lie inside the root."""
        last, inside, gone = self.elements[root][3], root == 0, 0
        found: dict[int, list[str]] = {}
        wanted: list[list[str]] = []
        for e in self.events:
            if isinstance(e, str):
                if inside and not gone:
                    for parts in wanted:
                        parts.append(e)
                continue
            at = abs(e)
            if at == root:
                inside = e > 0
                continue
            if not inside or not root < at < last:
                continue
            tag, classes, name, _ = self.elements[at]
            out = strip and (tag in STRIPPED_TAGS or any(c in STRIPPED_CLASSES for c in classes) or name in STRIPPED_IDS)
            if gone or out:
                gone += (1 if e > 0 else -1) if out else 0
            elif tag in tags:
                if e > 0:
                    found[at] = []
                    wanted.append(found[at])
                else:
                    wanted.pop()
        return [(at, self.elements[at][0], " ".join(parts)) for at, parts in found.items()]

    def title(self) -> str:
        """The first title's text."""
        at = self.first(lambda e: e[0] == "title")
        if at is None:
            return ""
        begun = self.events.index(at)
        return "".join(e for e in self.events[begun : self.events.index(-at, begun)] if isinstance(e, str))


def _read(pages: DataFrame, key: str, html: str, columns: str, found: Callable[[str], list[tuple]], more: tuple[str, ...] | None = None) -> DataFrame:
    """key and ``columns`` (the last two are texts) of the rows ``found`` in each page; with ``more``, a row for each page that has
    any: key, the columns ``more`` of pages, and the rows as the array found. Workers hold few pages and their texts at a time,
    however many there are."""
    fewer_arrow_rows(pages.sparkSession, PAGES_AT_ONCE)
    names = [key, *(c.split()[0] for c in columns.split(", "))]
    kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in columns.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = [], [], 0
            for k in range(batch.num_rows):
                new = found(batch[html][k].as_py() or "")
                at += [k] * len(new)
                rows += new
                size += sum(len(r[-1]) + len(r[-2]) for r in new)
                if rows and (size >= TOLD_AT_ONCE or k == batch.num_rows - 1):  # the last page hands on what is left
                    made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    if more is not None:
                        begins = [i for i, page in enumerate(at) if not i or page != at[i - 1]]
                        made = [pa.ListArray.from_arrays(pa.array([*begins, len(at)], pa.int32()), pa.StructArray.from_arrays(made, names[1:]))]
                        at = [at[i] for i in begins]
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(at, pa.int32())) for c in own), *made], [*own, "found"] if more is not None else names)
                    at, rows, size = [], [], 0

    own = (key, *(more or ()))
    given = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in own)
    shown = columns if more is None else "found array<struct<" + ", ".join(c.replace(" ", ": ", 1) for c in columns.split(", ")) + ">>"
    return pages.select(*own, html).mapInArrow(each, f"{given}, {shown}")


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html", tags: tuple[str, ...] = TEXT_TAGS, bare: bool = True) -> DataFrame:
    """key, seq, title, tag, text of headings, paragraphs and items of each page's content root, or of those of ``tags``.

    ``bare``: character references that no semicolon ends are read as browsers read them; else they are text."""

    out = _read(pages, key, html, BLOCK, _blocks(tags, bare)).select(key, "seq", "title", "tag", "text")
    return out.withColumns({"title": _title(F.col("title")), "text": clean_text("text")}).where("text != ''")


BLOCK = "seq long, tag string, title string, text string"


def _blocks(tags: tuple[str, ...], bare: bool) -> Callable[[str], list[tuple]]:
    def found(h: str) -> list[tuple]:
        page = _Page(h if bare else BARE.sub("&amp;", h))
        title = page.title()
        return [(at, tag, title, text) for at, tag, text in page.texts(page.root(), TEXT_TAGS) if tag in tags]

    return found


def _title(title: Column) -> Column:
    return strip(F.split_part(F.split_part(clean_text(title), F.lit(":"), F.lit(1)), F.lit(" - NHS"), F.lit(1)))


def sections(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, title, section_no, section, body of ``blocks``: text under its last heading, boilerplate and short sections apart."""
    pages = found.groupBy(key, "title").agg(F.array_sort(F.collect_list(F.struct("seq", "tag", "text"))).alias("_b"))
    return _sectioned(pages.select(key, "title", "_b"), F.col("_b"))


def page_sections(pages: DataFrame, key: str = "page_id", html: str = "html", bare: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """``sections`` of the ``blocks`` of pages, made where a page is read, so that no text is shuffled, with the columns ``more`` of
    pages; pages without a key have none."""
    read = _read(pages.where(F.col(key).isNotNull()), key, html, BLOCK, _blocks(TEXT_TAGS, bare), more)
    clean = F.transform("found", lambda b: F.struct(b["seq"].alias("seq"), b["tag"].alias("tag"), clean_text(b["text"]).alias("text")))
    title = _title(F.get("found", F.lit(0))["title"]).alias("title")
    return _sectioned(read.select(key, *more, title, "found"), F.filter(clean, lambda b: b["text"] != ""))


def _boilerplate(text: Column) -> Column:
    """Whether BOILERPLATE finds something; without any of its words, which are faster to look for, it doesn't."""
    some = let(F.lower(text), lambda low: reduce(or_, (F.contains(low, F.lit(w)) for w in BOILERPLATE_HAS)))
    return F.when(some, text.rlike(BOILERPLATE)).otherwise(False)


def _sectioned(pages: DataFrame, blocks: Column) -> DataFrame:
    """Sections of pages whose last column, which goes, holds ``blocks`` in document order: seq, tag, text."""
    heading = lambda b: b["tag"].isin("h1", "h2", "h3")
    start = F.coalesce(F.nullif("title", F.lit("")), F.lit("Overview"))

    def section(b: Column, cuts: Column, cut: Column, k: Column) -> Column:
        end = F.coalesce(F.get(cuts, k + 1), F.size(b))
        said = F.filter(F.slice(b, cut + 2, end - cut - 1), lambda x: ~heading(x) & ~_boilerplate(x["text"]))
        name = F.when(k == 0, start).otherwise(F.get(b, F.greatest(cut, F.lit(0)))["text"])
        return F.struct(k.cast("long").alias("section_no"), name.alias("section"), F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("body"))

    # The places of headings, after that of the page's beginning.
    places = lambda b: F.concat(F.array(F.lit(-1)), F.filter(F.transform(b, lambda x, i: F.when(heading(x), i)), lambda i: i.isNotNull()))
    made = let(blocks, lambda b: let(places(b), lambda cuts: F.transform(cuts, lambda cut, k: section(b, cuts, cut, k))))
    # An outer one: for others the optimiser adds a filter that works the sections out again; there is always one.
    out = pages.select(*pages.columns[:-1], F.inline_outer(made))
    return out.where((F.length("body") >= LEAST_CHARS) & ~F.col("section").rlike(SKIPPED_HEADING))


def split_long(text: Column | str, most: int = MOST_CHARS) -> Column:
    """Sentences packed in order into pieces of ``most`` characters at most; a longer sentence is a piece of its own.

    The fold carries numbers alone, the places where pieces begin; sentences are put together once, at the end."""
    text = F.col(text) if isinstance(text, str) else text
    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.struct(F.length(x).alias("n"), strip(x).alias("t")))
    sentences = F.filter(F.transform(sentences, lambda x: F.struct(x["n"].alias("n"), x["t"].alias("t"), F.length(x["t"]).alias("m"))), lambda x: x["m"] > 0)

    def add(state: Column, sentence: Column) -> Column:
        full = (state["size"] > 0) & (state["size"] + sentence["n"] + 1 > most)
        alone = full | (state["size"] == 0)
        return F.struct(
            F.when(full, F.array_append(state["cuts"], state["at"])).otherwise(state["cuts"]).alias("cuts"),
            (state["at"] + 1).alias("at"),
            F.when(alone, F.when(full, sentence["n"]).otherwise(sentence["m"])).otherwise(state["size"] + 1 + sentence["m"]).alias("size"),
        )

    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("at"), F.lit(0).alias("size"))
    ends = lambda lengths: F.aggregate(lengths, start, add, lambda s: F.when(s["size"] > 0, F.array_append(s["cuts"], s["at"])).otherwise(s["cuts"]))
    cut = lambda s, ends: F.transform(ends, lambda end, i: let(F.when(i > 0, F.get(ends, i - 1)).otherwise(0), lambda begin: F.array_join(F.transform(F.slice(s, begin + 1, end - begin), lambda x: x["t"]), " ")))
    pieces = let(sentences, lambda s: let(ends(F.transform(s, lambda x: F.struct(x["n"].alias("n"), x["m"].alias("m")))), lambda e: cut(s, e)))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(pieces)


def chunks(sectioned: DataFrame, sources: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """Chunks of all sections; of equal beginnings the first stays. ``sources``: key, url, source, test_ids, seq; or the sections
    have these columns. What is shuffled by its beginning's digest is the chunk alone, not the section's text beside each."""
    rows = sectioned if sources is None else sectioned.join(sources, key)
    own = ("test_ids", "title", "section", "source", "url")
    rows = rows.select("seq", "section_no", *own, F.posexplode_outer(split_long("body")).alias("piece_no", "text")).where("text is not null")
    rows = rows.select(F.struct("seq", "section_no", "piece_no").alias("ordinal"), *own, "text")
    rows = first_wins(rows, [F.unhex(F.sha2(fingerprint("text"), 256))], "ordinal")
    topic = F.coalesce(F.nullif("title", F.lit("")), F.col("section"))
    embed = F.concat(F.col("title"), F.lit(" - "), F.col("section"), F.lit(": "), F.col("text"))
    return rows.select("ordinal", "test_ids", topic.alias("topic"), "section", "text", embed.alias("embed_text"), "source", "url")


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, seq, href, title of every link in the content root, stripped parts included; some titles are empty."""

    def found(h: str) -> list[tuple]:
        page = _Page(h)
        return [(i, page.hrefs[at], text) for i, (at, _, text) in enumerate(page.texts(page.root(), ("a",), strip=False)) if at in page.hrefs]

    out = _read(pages, key, html, "seq long, href string, title string", found)
    return out.withColumn("title", clean_text("title"))


def discover(pages: DataFrame, key: str = "page_id", html: str = "html", link: str = LAB_TEST_LINK) -> DataFrame:
    """url, ids of the lab-test pages that index pages link to; the first link of a url counts, and is none if it has no text."""
    found = links(pages, key, html).where(F.col("href").rlike(link)).withColumn("at", F.struct(key, "seq"))
    return first_wins(found, ["href"], "at").where("title != ''").select(F.col("href").alias("url"), derive_test_ids("title").alias("ids"))


def outside(rows: DataFrame, url: str, hosts: tuple[str, ...]) -> DataFrame:
    """Rows whose url's host is not one of ``hosts`` or missing."""
    host = F.try_parse_url(F.col(url), F.lit("HOST"))
    return rows.where(~F.coalesce(host.isin(*hosts), F.lit(False)))


def assert_inside(rows: DataFrame, url: str, hosts: tuple[str, ...]) -> DataFrame:
    bad = outside(rows, url, hosts).select(url).limit(1).collect()
    if bad:
        raise ValueError(f"source outside the approved hosts: {bad[0][0]}")
    return rows
