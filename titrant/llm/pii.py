"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them.

Everything is DataFrame and SQL functions. A pattern gives its matches and, by splitting at the matches, the gaps between
them; running sums of their lengths are the positions in code points. Patterns are written so that they neither recurse
nor rescan on long runs, and match what the plain forms match.

Method: the values found are the protected entities. A term (a word of ``LETTERS`` letters or more) co-occurs with an
entity in each document that has both, wherever they stand. Over all documents, with N documents, n(t) that have the term,
n(c) that have the entity and n(t, c) that have both, the term discloses

    PMI(t; c) / IC(c) = log2(N n(t, c) / (n(t) n(c))) / log2(N / n(c))

of the entity's information. Terms that co-occur with it in ``SUPPORT`` documents or more and disclose ``DISCLOSED`` or
more become spans of kind ``term`` wherever they stand, outside base spans, in a document that has the entity. ``sanitise``
puts the kind in place of a base span, generalises disclosing terms to their first letter, and removes those that disclose
``REMOVED`` or more.

What stands in exactly the same documents has the same counts with everything, so entities form classes by their documents
(by fingerprints of 64 bits of these), and so do terms; a document pairs classes, not entities with terms. A list of any
number of addresses that is copied from place to place is one class beside one class of its terms.

Only documents with an entity that ``SUPPORT`` documents have can give pairs, and of their terms only those with
n(t) <= N (n(c) / N) ** DISCLOSED, which every disclosing term meets as n(t, c) <= n(c); so pairs grow with the documents
that hold shared entities, not with the corpus. Counts are pre-aggregated before each shuffle, frequent entities, terms and
pairs are dealt over tasks, and texts are read again by their place instead of being shuffled.

Cases: null texts count as empty and have no spans; repeated rows and repeated or missing doc_ids are rows of their own,
told apart by their place; texts may be long and hold many entities; an entity that all documents have carries no information and no term discloses it; a term in two
entities' pairs has the larger disclosure; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLACE, forget, keep_rows, place, spread_join, stored, texts, written

KINDS = ("email", "ip", "card", "phone")
LETTERS, SUPPORT, DISCLOSED, REMOVED = 4, 2, 0.75, 0.95
BLOCK = 256  # elements of a running sum that are added one by one

#: Kind: the pattern for Java, the condition on a text for having any match, the condition on a match m.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"text rlike r'[0-9]\.[0-9]'", "forall(split(m, '[.]'), p -> coalesce(try_cast(right(p, 9) as int) <= 255 and ltrim('0', left(p, length(p) - 9)) = '' or length(p) < 10 and try_cast(p as int) <= 255, false))"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"text rlike r'[0-9][\x20-]?[0-9]'", "length(replace(replace(m, ' ', ''), '-', '')) between 13 and 19 and {luhn}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", r"length(regexp_replace(m, r'[^0-9]', '')) between 9 and 15"),
}
LUHN = """aggregate(sequence(1, length(replace(replace(m, ' ', ''), '-', ''))), 0, (s, i) -> s + element_at(
    array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9),
    1 + 10 * ((i + 1) % 2) + cast(substring(reverse(replace(replace(m, ' ', ''), '-', '')), i, 1) as int))) % 10 = 0"""


def running(name: str) -> str:
    """SQL for the running sums of the array column ``name``, in blocks so that long arrays aren't copied for each element."""
    fold = "aggregate({a}, cast(array() as array<bigint>), (s, x) -> array_append(s, coalesce(try_element_at(s, -1), 0L) + x))"
    blocks = f"transform(sequence(0, (size({name}) - 1) div {BLOCK}), b -> slice({name}, b * {BLOCK} + 1, {BLOCK}))"
    sums = fold.format(a=f"transform({blocks}, k -> aggregate(k, 0L, (s, x) -> s + x))")
    return f"case when size({name}) = 0 then cast(array() as array<bigint>) else flatten(zip_with({blocks}, {sums}, (k, total) -> transform({fold.format(a='k')}, x -> x + total - aggregate(k, 0L, (s, y) -> s + y)))) end"


def base_spans(docs: DataFrame) -> DataFrame:
    """Each row with a column for each kind: array of start_at, end_at, value."""
    out = docs
    none = "cast(array() as array<string>)"
    for kind, (pattern, likely, _) in PATTERNS.items():
        java = pattern.replace("'", r"\'")
        out = out.withColumn(f"{kind}_m", F.expr(f"case when {likely} then regexp_extract_all(text, r'{java}', 0) else {none} end"))
        out = out.withColumn(f"{kind}_g", F.expr(f"case when size({kind}_m) > 0 then split(text, r'{java}', -1) else {none} end"))
        out = out.withColumn(f"{kind}_a", F.expr(f"zip_with({kind}_m, slice({kind}_g, 1, size({kind}_m)), (m, g) -> cast(length(m) + length(g) as bigint))"))
        out = out.withColumn(f"{kind}_e", F.expr(running(f"{kind}_a")))
    for kind, (_, _, valid) in PATTERNS.items():
        valid = valid.format(luhn=LUHN) if kind == "card" else valid
        all_ = f"transform({kind}_m, (m, i) -> struct({kind}_e[i] - length(m) as start_at, {kind}_e[i] as end_at, m as value))"
        out = out.withColumn(kind, F.expr(f"filter({all_}, s -> element_at(transform(array(s.value), m -> {valid}), 1))"))
    return out.drop(*(f"{k}_{x}" for k in KINDS for x in "mgae"))


def _spans() -> str:
    """SQL for all base spans of a row, by kind, then start."""
    return f"concat({', '.join(KINDS)})"


def disclosing(docs: DataFrame) -> DataFrame:
    """file, row, terms (map of term to disclosure) of each row of a ``stored`` table that holds disclosing terms."""
    total = docs.count()
    found = base_spans(texts(docs, *place(docs)))
    each = ", ".join(f"transform({k}, s -> xxhash64('{k}', lower(s.value)))" for k in KINDS)
    entity = F.expr(f"explode(array_distinct(concat({each})))")
    held = written(found.select("file", "row", entity.alias("entity")), "pii_entities")
    n_c = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), _documents("entity_class")).where(f"n_c >= {SUPPORT} and n_c < {total}")
    n_c = written(n_c, "pii_shared_entities")
    shared = spread_join(held, n_c, "entity", "file, row", counts=n_c.select("entity", F.col("n_c").alias("n")))
    shared = shared.groupBy("file", "row").agg(F.collect_set(F.struct("entity_class", "n_c")).alias("entities"))  # of one text
    shared = written(shared, "pii_holders", held)
    words = "array_distinct(split(lower(text), '[^\\\\p{L}]+'))"
    terms = lambda frame, *more: texts(frame, *more).select(*_names(more), F.explode(F.expr(words)).alias("term")).where(f"length(term) >= {LETTERS}")
    rare = n_c.agg(F.max("n_c")).first()[0] or 0
    n_t = terms(docs, *place(docs)).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"), _documents("term_class")).where(f"n_t >= {SUPPORT} and n_t <= {_most(total, rare)}")
    own = written(terms(keep_rows(docs, shared.select("file", "row"), places=True), *PLACE), "pii_terms")
    own = spread_join(own, n_t, "term", ", ".join(PLACE)).select(F.col(PLACE[0]).alias("file"), F.col(PLACE[1]).alias("row"), "term", "n_t", "term_class")
    own = written(own, "pii_own_terms")
    pairs = own.select("file", "row", "n_t", "term_class").distinct().join(shared, ["file", "row"]).select("file", "row", "n_t", "term_class", F.explode("entities").alias("e"))
    likely = f"n_t <= {total}D * pow(e.n_c / {total}D, {DISCLOSED}) * 1.000001"
    pairs = written(pairs.where(likely).select("file", "row", "term_class", "n_t", "e.n_c", F.expr("xxhash64(e.entity_class, term_class)").alias("pair")), "pii_pairs", shared)
    disclosure = F.expr(f"log2({total}D * n / (n_t * n_c)) / log2({total}D / n_c)")
    revealing = pairs.groupBy("pair", "n_t", "n_c").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {SUPPORT}").withColumn("disclosure", disclosure)
    revealing = written(revealing.where(f"disclosure >= {DISCLOSED}").select("pair", "n", "disclosure"), "pii_revealing", n_c)
    marked = spread_join(pairs.select("file", "row", "term_class", "pair"), revealing.select("pair", "disclosure"), "pair", "file, row", counts=revealing.select("pair", "n"))
    marked = marked.groupBy("file", "row", "term_class").agg(F.max("disclosure").alias("disclosure"))
    marked = own.join(marked, ["file", "row", "term_class"]).groupBy("file", "row").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("terms"))  # of one text
    marked = written(marked, "pii_marked", pairs, own)
    forget(revealing)
    return marked


def _names(columns: tuple) -> list[str]:
    return [c if isinstance(c, str) else n for c, n in zip(columns, ("file", "row"), strict=True)]


def _documents(name: str) -> Column:
    """A class that what stands in the same documents shares: their number, sum and exclusive or of two 64-bit hashes."""
    sums = "sum(cast(xxhash64(file, row) as decimal(38, 0))), bit_xor(xxhash64(row, file, 1))"
    return F.expr(f"xxhash64(count(1), {sums})").alias(name)


def _most(total: int, n_c: int) -> int:
    """Documents that may have a term which discloses an entity of ``n_c`` documents."""
    return int(total * (n_c / max(1, total)) ** DISCLOSED * 1.000001) if n_c else 0


def _with_terms(docs: DataFrame) -> DataFrame:
    """doc_id, text, a column of spans for each kind, and ``term``: start_at, end_at, disclosure."""
    docs = stored(docs)
    marked = disclosing(docs)
    places = marked.select("file", "row")
    kind = "array<struct<start_at: bigint, end_at: bigint, disclosure: double>>"
    plain = base_spans(texts(keep_rows(docs, places, others=True))).withColumn("term", F.expr(f"cast(array() as {kind})"))
    some = base_spans(texts(keep_rows(docs, places, places=True), *PLACE)).join(marked, F.expr(f"{PLACE[0]} = file and {PLACE[1]} = row"))
    some = some.withColumn("w", F.expr(r"regexp_extract_all(text, r'\p{L}++', 0)")).withColumn("g", F.expr(r"split(text, r'\p{L}++', -1)"))
    some = some.withColumn("a", F.expr("zip_with(w, slice(g, 1, size(w)), (w, g) -> cast(length(w) + length(g) as bigint))")).withColumn("e", F.expr(running("a")))
    told = "filter(transform(w, (w, i) -> struct(e[i] - length(w) as start_at, e[i] as end_at, terms[lower(w)] as disclosure)), t -> t.disclosure is not null)"
    some = some.withColumn("found", F.expr(told)).withColumn("base", F.expr(_spans()))
    some = some.withColumn("term", F.expr(f"cast(filter(found, t -> not exists(base, s -> s.start_at < t.end_at and t.start_at < s.end_at)) as {kind})"))
    return plain.unionByName(some.select(*plain.columns))


def _clean() -> str:
    """SQL for the text with base spans replaced by their kind, disclosing terms generalised or removed. Of spans of two
    kinds that overlap the first counts; what is between two spans stays."""
    put = [f"transform({k}, s -> struct(s.start_at, s.end_at, '[{k.upper()}]' as put))" for k in KINDS]
    put.append(f"transform(term, s -> struct(s.start_at, s.end_at, case when s.disclosure >= {REMOVED} then '' else '*' end as put))")
    state = "struct(cast(array() as array<string>) as parts, 0L as at)"
    shown = "case when s.put = '*' then concat(substring(text, cast(s.start_at as int) + 1, 1), '***') else s.put end"
    step = f"case when s.start_at >= a.at then struct(array_append(a.parts, concat(substring(text, cast(a.at as int) + 1, cast(s.start_at - a.at as int)), {shown})) as parts, s.end_at as at) else a end"
    done = "concat(array_join(a.parts, ''), substring(text, cast(a.at as int) + 1))"
    return f"case when size(concat({', '.join(KINDS)})) + size(term) = 0 then text else aggregate(array_sort(concat({', '.join(put)})), {state}, (a, s) -> {step}, a -> {done}) end"


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, sanitised_sha256."""
    out = _with_terms(docs)
    told = {k: F.expr(f"transform({k}, s -> concat('{k}:', s.start_at, ':', s.end_at))") for k in (*KINDS, "term")}
    base = F.concat(*(told[k] for k in KINDS))
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, told["term"])).alias("spans"),
        F.size("term").cast("long").alias("n_term"),
        F.sha2(F.expr(_clean()), 256).alias("sanitised_sha256"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text with base spans replaced by their kind, disclosing terms generalised or removed."""
    return _with_terms(docs).select("doc_id", F.expr(_clean()).alias("text"))
