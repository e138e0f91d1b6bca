"""Phrase collocation mining by count tries.

Texts are lower-cased (A-Z), cut into pieces at ``BREAKS`` and pieces into words at spaces and tabs. Every task counts the
phrases of up to three words of its texts in tries, one for each language, and hands a trie on when it has read
``SHARD_WORDS`` words or holds ``SHARD_NAMES`` different ones: nodes in the byte order of their words, with counts and
numbers of children, cut into ranges of paths. The tries' pieces of one range are merged: runs that are sorted already, equal
nodes added.

Ranges end at paths, the quantiles of a bounded sample of documents (which decides their sizes, not the result). A range that
begins below a word or a pair gets that word's or pair's count from every trie too, so a walk from the root knows the left parts
of each phrase. Beyond ``RANGES`` ranges, each is cut further by a hash of the first two words, which get the first word's
count in the same way.

Nodes with ``LEAST`` occurrences are written. Their suffix links, from a phrase to the phrase without its first words,
bring the counts of the right parts, which stand in other ranges; words that end very many phrases are spread over tasks. All
parts of a phrase occur as often as it does, so no count that a score needs is under ``LEAST``.

    score = floor(1000000 a a / (l r)), the least over the cuts of the phrase into a left and a right part

Scores are exact in 38 digits, for phrases that occur up to 10**16 times. A phrase is dropped if a longer one that holds it has
at least ``COVERED`` per cent of its occurrences.

Cases: null texts count as empty, a null language as ``und``; texts without words add nothing; repeated rows count as often as
they stand there; texts of any length are read in blocks; equal scores are ordered by occurrences, then phrase in byte order;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, forget, spread_join, written

BREAKS = ".,;:!?\n\x0b\x0c\r"
LEAST, COVERED, FIRST = 10, 50, 2000
SHARD_WORDS, SHARD_NAMES = 1 << 21, 1 << 20
TEXT_BLOCK = 1 << 20  # bytes of a text that are split at once: at most half as many words
RANGE_CHARS = 1 << 21  # characters of text to a range of paths
RANGES = 1 << 15
SAMPLE, SAMPLE_PATHS = 2048, 64  # documents, paths of each, that the ranges are chosen by
RANKED = 1 << 13  # phrases of a language that are ranked together

PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + BREAKS.encode(), bytes(range(97, 123)) + b" " + b"\n" * len(BREAKS))
EMPTY, END = 0, 1  # ids of what stands between two spaces and of a piece's end


def split(text: str) -> Iterator[list[bytes]]:
    """Words, ends of pieces (a line end) and empty words of a text, block by block."""
    data = text.encode("utf-8", "surrogatepass").translate(PLAIN).replace(b"\n", b" \n ")
    at = 0
    while at < len(data):
        to = at + TEXT_BLOCK
        if to < len(data):
            to = data.rfind(b" ", at, to) + 1 or data.find(b" ", to) + 1 or len(data)
        yield data[at:to].split(b" ")
        at = to


def paths(text: str) -> list[tuple[bytes, ...]]:
    """Up to ``SAMPLE_PATHS`` paths of three words, evenly spaced in the text."""
    words = [w for block in split(text) for w in block if w]
    out = []
    for s in range(0, len(words), max(1, -(-len(words) // SAMPLE_PATHS))):
        path = words[s : s + 3]
        path = path[: path.index(b"\n")] if b"\n" in path else path
        if path:
            out.append(tuple(path))
    return out


class Shard:
    """Streams of word ids by language, from which the nodes of the tries are counted."""

    def __init__(self, bounds: list[tuple[bytes, ...]], pieces: int) -> None:
        self.bounds, self.pieces = bounds, pieces
        self._clear()

    def _clear(self) -> None:
        self.names: defaultdict[bytes, int] = defaultdict(count(2).__next__)
        self.names[b""], self.names[b"\n"] = EMPTY, END
        self.streams: defaultdict[str, list[np.ndarray]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, text: str) -> Iterator[tuple[int, str, bytes]]:
        """Take in a text; the pieces of full tries come out, also in the middle of it."""
        for words in split(text):
            ids = np.fromiter(map(self.names.__getitem__, words), np.int32, len(words))
            ids = ids[ids != EMPTY]
            if not len(ids):
                continue
            self.streams[lang].append(ids)
            self.size += len(ids)
            if self.size >= SHARD_WORDS or len(self.names) >= SHARD_NAMES:
                own = np.concatenate(self.streams[lang][-2:])
                carried = {v: k for k, v in self.names.items() if v in own[-2:].tolist()}
                tail = [carried[v] for v in own[-2:].tolist()]
                yield from self.cut({lang: len(tail)})
                # They begin the next trie: phrases that start there are counted there.
                self.streams[lang].append(np.array([self.names[w] for w in tail], np.int32))
        self.streams[lang].append(np.array([END], np.int32))

    def cut(self, carried: dict[str, int] | None = None) -> Iterator[tuple[int, str, bytes]]:
        """The pieces (range, language, trie) of the tries; the last ``carried`` words of a language start no phrase here."""
        names, streams = self.names, self.streams
        self._clear()
        words = sorted(w for w, i in names.items() if i > END)
        rank = np.zeros(len(names), np.int64)
        rank[[names[w] for w in words]] = np.arange(1, len(words) + 1)
        bits = len(words).bit_length()
        edges = self._edges(words, bits)
        hashes = np.array([0, *map(zlib.crc32, words)], np.int64) if self.pieces > 1 else None
        for lang, parts in streams.items():
            own = rank[np.concatenate(parts)]
            starts = len(own) - (carried or {}).get(lang, 0)
            own = np.r_[own, 0, 0]
            a, b, c = own[:starts], own[1 : starts + 1], own[2 : starts + 2]
            pairs = (a > 0) & (b > 0)
            triples = pairs & (c > 0)
            levels = [np.unique(k, return_counts=True) for k in (a[a > 0], a[pairs] << bits | b[pairs], (a[triples] << bits | b[triples]) << bits | c[triples])]
            yield from self._pieces(lang, words, bits, levels, edges, hashes)

    def _edges(self, words: list[bytes], bits: int) -> list[tuple[int, int, int]]:
        """For each bound the first node of each level, as packed ranks, that isn't before it."""
        out = []
        for bound in self.bounds:
            at, known = [0, 0, 0], True
            for k, w in enumerate(bound):
                at[k] = bisect_left(words, w) + 1
                if at[k] > len(words) or words[at[k] - 1] != w:
                    known = False
                    break
            one, two = at[0], at[0] << bits | at[1]
            # A node is before the bound if its path is; a known prefix of the bound is before it.
            first = one + (known and len(bound) > 1 or at[1] > 0)
            second = two + (known and len(bound) > 2 or at[2] > 0)
            out.append((first, second, two << bits | at[2]))
        return out

    def _pieces(self, lang, words, bits, levels, edges, hashes) -> Iterator[tuple[int, str, bytes]]:
        cuts = [np.r_[0, np.searchsorted(keys, [e[k] for e in edges]), len(keys)].astype(np.int64) for k, (keys, _) in enumerate(levels)]
        for r in range(len(edges) + 1):
            nodes = [(keys[c[r] : c[r + 1]], n[c[r] : c[r + 1]]) for (keys, n), c in zip(levels, cuts, strict=True)]
            if r:  # what stands above the range's beginning
                bound = self.bounds[r - 1]
                nodes[:2] = [self._with_path(words, bits, bound[: k + 1], levels[k], nodes[k]) if len(bound) > k + 1 else nodes[k] for k in (0, 1)]
            if not any(len(keys) for keys, _ in nodes):
                continue
            if hashes is None:
                yield r, lang, _serialised(words, bits, nodes)
                continue
            deal = [(hashes[k >> s] * 31 + hashes[k >> s - bits & (1 << bits) - 1]) % self.pieces for (k, _), s in zip(nodes[1:], (bits, 2 * bits), strict=True)]
            for p in range(self.pieces):
                yield r * self.pieces + p, lang, _serialised(words, bits, [nodes[0], *((k[d == p], n[d == p]) for (k, n), d in zip(nodes[1:], deal, strict=True))])

    @staticmethod
    def _with_path(words, bits, path, level, nodes):
        key = 0
        for w in path:
            at = bisect_left(words, w)
            if at == len(words) or words[at] != w:
                return nodes
            key = key << bits | at + 1
        at = np.searchsorted(level[0], key)
        if at == len(level[0]) or level[0][at] != key:
            return nodes
        return np.r_[key, nodes[0]], np.r_[level[1][at], nodes[1]]


def _serialised(words: list[bytes], bits: int, nodes: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """A trie's piece: its words, then for each level the nodes' words and counts, and for the first two their children."""
    last = [keys & (1 << bits) - 1 for keys, _ in nodes]
    used = np.unique(np.concatenate(last))
    table = b" ".join([words[k - 1] for k in used.tolist()])
    children = [np.diff(np.searchsorted(lower >> bits, np.r_[keys, keys[-1:] + 1])) for (keys, _), (lower, _) in zip(nodes[:2], nodes[1:], strict=True)]
    head = np.array([len(table), *(len(keys) for keys, _ in nodes)], np.int64)
    body = [np.searchsorted(used, x).astype(np.int32) for x in last] + [n.astype(np.int32) for _, n in nodes] + [c.astype(np.int32) for c in children]
    return head.tobytes() + table + b"".join(x.tobytes() for x in body)


def _parsed(data: bytes) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    size, *n = np.frombuffer(data, np.int64, 4).tolist()
    at, out = 32 + size, []
    for k in (*n, *n, n[0], n[1]):
        out.append(np.frombuffer(data, np.int32, k, at))
        at += 4 * k
    return data[32 : 32 + size].split(b" "), out[:3], out[3:6], out[6:]


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs: distinct keys with their counts added (a stable sort takes runs as they are)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def merged(tries: list[bytes], bound: tuple[bytes, ...], own_first: bool, least: int) -> tuple[int, list[tuple[int, bytes, int, int, int]]]:
    """(words, nodes) of the pieces of one range and language: the occurrences of the words that belong to the range, and
    (depth, phrase, count, count of the first word, count of the first two) of the nodes with ``least`` occurrences or more.
    What stands above the range's beginning, ``bound``, belongs to an earlier range."""
    parsed = [_parsed(t) for t in tries]
    names = sorted(set().union(*(p[0] for p in parsed)))
    index = {w: k for k, w in enumerate(names)}
    bits = max(1, len(names).bit_length())
    keys, n = [[], [], []], [[], [], []]
    for words, last, counts, children in parsed:
        to = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        one = to[last[0]]
        two = np.repeat(one, children[0]) << bits | to[last[1]]
        for level, k in enumerate((one, two)):
            keys[level].append(k)
        keys[2].append((np.repeat(two, children[1]), to[last[2]]))
        for level in range(3):
            n[level].append(counts[level].astype(np.int64))
    n = [np.concatenate(x) for x in n]
    one, n1 = _added(np.concatenate(keys[0]), n[0])
    two, n2 = _added(np.concatenate(keys[1]), n[1])
    above, third = (np.concatenate([k[j] for k in keys[2]]) for j in (0, 1))
    three, n3 = _added(np.searchsorted(two, above) << bits | third, n[2])
    low = (1 << bits) - 1
    head = [index.get(w, -1) for w in bound]
    owned = np.full(len(one), own_first)
    if len(bound) > 1:
        owned &= one != head[0]
    pairs = two != (head[0] << bits | head[1]) if len(bound) > 2 and min(head[:2]) >= 0 else np.ones(len(two), bool)
    left = n1[np.searchsorted(one, two >> bits)]
    out = [(1, names[k], int(c), 0, 0) for k, c in zip(one[owned & (n1 >= least)].tolist(), n1[owned & (n1 >= least)].tolist(), strict=True)]
    for k in np.flatnonzero(pairs & (n2 >= least)).tolist():
        out.append((2, names[two[k] >> bits] + b" " + names[two[k] & low], int(n2[k]), int(left[k]), 0))
    for k in np.flatnonzero(n3 >= least).tolist():
        p = three[k] >> bits
        out.append((3, b" ".join((names[two[p] >> bits], names[two[p] & low], names[three[k] & low])), int(n3[k]), int(left[p]), int(n2[p])))
    return int(n1[owned].sum()), out


def _plan(docs: DataFrame) -> tuple[list[tuple[bytes, ...]], int]:
    """Bounds of the ranges and pieces of each, by the number of rows and a sample of ``SAMPLE`` documents."""
    rows = docs.count()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch["text"]:
                some = [b" ".join(p) for p in paths(t.as_py())]
                yield pa.RecordBatch.from_pydict({"chars": [len(t.as_py())], "paths": pa.array([some], pa.list_(pa.binary()))})

    some = docs.sample(min(1.0, SAMPLE / max(1, rows)), 42) if rows > SAMPLE else docs
    with arrow_rows(docs.sparkSession):
        seen = some.select("text").mapInArrow(each, "chars long, paths array<binary>").collect()  # about SAMPLE rows
    chars = sum(r["chars"] for r in seen) / max(1, len(seen)) * rows
    found = sorted(tuple(bytes(p).split(b" ")) for r in seen for p in r["paths"])
    parts = -(-int(chars) // RANGE_CHARS)
    ranges = max(1, min(RANGES, parts, len(found)))
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}), max(1, -(-parts // RANGES))


def count_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, depth, phrase, n, n_1, n_2: phrases of one to three words with ``least`` occurrences or more, with the counts of their
    first and first two words; depth 0 has the words of the language, in parts to be added."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bounds, pieces = _plan(docs)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(bounds, pieces)
        batch_of = lambda rows: pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "lang": pa.array([r[1] for r in rows], pa.string()), "trie": pa.array([r[2] for r in rows], pa.binary())})
        rows: list[tuple[int, str, bytes]] = []
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for row in shard.add(lang.as_py(), text.as_py()):
                    rows.append(row)
                    if len(rows) == 64:
                        yield batch_of(rows)
                        rows = []
        for row in shard.cut():
            rows.append(row)
            if len(rows) == 64:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)

    def merge(key: tuple, tries: pa.Table) -> pa.Table:
        part, lang = key[0].as_py(), key[1].as_py()
        r, piece = divmod(part, pieces)
        total, nodes = merged(tries["trie"].to_pylist(), bounds[r - 1] if r else (), piece == 0, least)
        nodes.append((0, b"", total, 0, 0))
        columns = list(zip(*nodes, strict=True))
        return pa.table({
            "lang": pa.array([lang] * len(nodes), pa.string()), "depth": pa.array(columns[0], pa.int32()),
            "phrase": pa.array([p.decode("utf-8", "replace") for p in columns[1]], pa.string()),
            **{name: pa.array(c, pa.int64()) for name, c in zip(("n", "n_1", "n_2"), columns[2:], strict=True)},
        })

    with arrow_rows(docs.sparkSession):
        tries = docs.mapInArrow(shards, "part int, lang string, trie binary")
        return written(tries.groupBy("part", "lang").applyInArrow(merge, "lang string, depth int, phrase string, n long, n_1 long, n_2 long"), "phrase_counts")


def _scored(nodes: DataFrame) -> DataFrame:
    """lang, phrase, depth, a, l, r, score: the cut of each phrase that scores least."""
    first = "substring(phrase, instr(phrase, ' ') + 1)"
    last = "substring_index(phrase, ' ', -1)"
    cuts = f"explode(case when depth = 2 then array(struct(1 as k, n_1 as l, {last} as right)) else array(struct(1 as k, n_1 as l, {first} as right), struct(2 as k, n_2 as l, {last} as right)) end)"
    links = nodes.where("depth > 1").select("lang", "phrase", "depth", F.col("n").alias("a"), F.expr(cuts).alias("c"))
    links = written(links.select("lang", "phrase", "depth", "a", "c.k", "c.l", F.struct("lang", F.col("c.right").alias("phrase")).alias("right")), "suffix_links")
    ends = nodes.where("depth between 1 and 2").select(F.struct("lang", "phrase").alias("right"), F.col("n").alias("r"))
    scores = spread_join(links, ends, "right", "phrase").withColumn("score", F.expr("(cast(1000000 as decimal(38, 0)) * a * a) div (cast(l as decimal(19, 0)) * r)"))
    least = scores.groupBy("lang", "phrase", "depth", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "depth", "a", "cut.l", "cut.r", "cut.score")


def _covered(nodes: DataFrame) -> DataFrame:
    """lang, phrase, most: for two words inside phrases of three, the occurrences of the most frequent of these."""
    inside = "explode(array(substring_index(phrase, ' ', 2), substring(phrase, instr(phrase, ' ') + 1)))"
    return nodes.where("depth = 3").select("lang", F.expr(inside).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` phrases of each language."""
    nodes = count_phrases(docs, least)
    scored = _scored(nodes).join(_covered(nodes), ["lang", "phrase"], "left")
    stay = written(scored.where(f"depth = 3 or most is null or 100 * most < {covered} * a").drop("depth", "most"), "phrases")
    n = nodes.where("depth = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    order = (F.desc("score"), F.desc("a"), "phrase")
    top, most = stay, stay.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    while most > max(RANKED, 2 * first):  # in salts first, so that a language of any size is ranked by many tasks
        salts = -(-most // max(RANKED, 2 * first))
        salted = Window.partitionBy("lang", F.expr(f"pmod(xxhash64(phrase), {salts})")).orderBy(*order)
        top, most = top.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= first).drop("rank"), salts * first
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    out = written(top.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")), "collocations", stay)
    forget(nodes)
    return out


ORACLE_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w),
g AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM s, range(1, 4) t(k) WHERE s + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST}),
cut AS (SELECT *, array_to_string(w[:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
sc AS (
  SELECT cut.lang, cut.k, cut.phrase, a, w, j, l.n AS l, r.n AS r, ((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase, a FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
stay AS (SELECT best.* FROM best LEFT JOIN most USING (lang, phrase) WHERE k = 3 OR most IS NULL OR 100 * most < {COVERED} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank, phrase, a, l, r, total.n AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= {FIRST}
"""
