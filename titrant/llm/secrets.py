"""Secret scans: candidates by rules, false positives removed by a random forest.

Candidates of a whole text: runs of ``[A-Za-z0-9+/_=-]`` of 16 characters or more with a digit, with the beginning of an
issued key, or that go from lower to upper case ``HUMPS`` times; values of six characters or more that a credential word
assigns (``password: ...``, ``token = "..."``), wherever in a URL or connection string the assignment stands, and after the name
of a way to authorise (``Authorization: Bearer ...``) the word that follows it; and passwords of a URL's login
(``://user:...@host``). Of candidates that overlap a login counts first, then an assigned value.

Each candidate has features of its length, transitions between character classes, coverage by dictionary words, the
path it may be part of and the neighbouring words. A forest of ``TREES`` trees, grown in numpy on the driver from
labelled findings, gives the share of trees' votes that it is a secret; findings under ``ACCEPT`` are false positives.
Labelled findings are a parameter (text, start, end, secret); by default ``labelled_findings`` writes ``SAMPLE`` of them
in the styles that credentials and look-alikes (digests, identifiers, card numbers, paths, placeholders) have. The names it
puts beside them are drawn half from lists of its own that no feature knows, so that the forest can't rest on those alone.

Cases: null and empty texts have no findings and stay as they are; a text of any length is one pass, candidates are merged
and redacted in one more over them, and runs may be of any length; the same text twice gives the same findings twice;
repeated and missing doc_ids have rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts

LEAST, ASSIGNED = 16, 6
TREES, DEEP, LEAF, SAMPLE, SEED = 31, 10, 3, 3000, 11
ACCEPT = 0.5
REDACTED = "[SECRET]"
NEAR = 60  # characters around a candidate that hold its neighbouring words

# Words next to credentials, words next to look-alikes, beginnings of issued keys, dictionary.
CREDENTIAL = "token key secret password passwd pwd auth bearer credential credentials apikey api access private authorization login passphrase".split()
BENIGN = "commit sha sha1 sha256 md5 checksum uuid guid digest etag revision hash order invoice card isbn version build trace request session example placeholder sample image figure file path blob color serial tracking account phone".split()
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "glpat-", "eyJ", "SG.")
WORDS = (
    "the and for with from that this are was not you all any can had her his one our out day get has him how man new now old see two way who "
    "about after again also back because been before between both call come could data each even find first give good great here home into just "
    "know large last life like line list little long look made make many more most much must name need next number other over page part people "
    "place point right same school should show small some state still such take test text than their them then there these they thing think time "
    "under user value very want water well were what when where which while will word work world would write year your build class config error "
    "event field file function group header image index input item label layer level link model module node object option output package param "
    "path process project query report request result return server service session source string table target token type update version view"
).split()

RUN = re.compile(f"(?:[0-9]|{'|'.join(map(re.escape, ISSUED))})[A-Za-z0-9+/_=-]*")
SEPARATOR = re.compile("(?<=[A-Za-z\"'`\\])\\t ])[:=][=>]?[ \\t]{0,3}([\"'`]?)")
QUOTED = re.compile("[^\\s\"'`]+")
# Without quotes a value ends at a mark that another assignment, white space, a quote or the end follows; in a query string at any.
BARE = re.compile("(?:[^\\s\"'`&;,]|[&,](?!\\s|[\"'`]|$|[A-Za-z_][\\w.%\\[\\]-]{0,40}[=:])|;(?!\\s|[\"'`]|$|[A-Za-z_][\\w.% -]{0,40}=))+")
IN_QUERY = re.compile("[^\\s\"'`&;,#]+")
QUERY_BEFORE = re.compile("[?&][\\w.%\\[\\]-]*$")
CREDENTIAL_BEFORE = re.compile(f"(?i)(?:{'|'.join(CREDENTIAL)})[\"'`\\])]?[ \\t]*$")
# After the name of a way to authorise, the value is the next word.
SCHEME = re.compile("(?i)(?:bearer|basic|digest|token|apikey|negotiate)[ \\t]{1,3}(?=[^\\s\"'`])")
LOGIN = re.compile("://[^\\s/?#@:\"'`]{0,100}:([^\\s/?#\"'`]{3,200})@")
LOGIN_BEFORE = re.compile("://[^\\s/?#@:\"'`]{0,100}:$")
SCHEME_BEFORE = re.compile("(?i)\\b(?:bearer|basic|digest|token|apikey|negotiate)[ \\t]{1,3}$")
PLACEHOLDER = re.compile("(?i)<[^>]*>|\\$\\{|\\{\\{|^\\$[a-z_]+$|%[a-z_]+%|\\*{3}|\\.\\.\\.|(.)\\1{5}|your|example|changeme|placeholder|redacted|dummy|insert|replace|todo|none|null|undefined|required|getenv|environ|process\\.|config\\.|settings\\.")
HUMP, HUMPS = re.compile("[a-z][A-Z]"), 3  # from lower to upper case: how often in a run without digits
UUID = re.compile("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGITS = frozenset("0123456789")
RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
NEIGHBOUR = re.compile("[A-Za-z0-9]+")
DICTIONARY = re.compile("|".join(sorted((w for w in WORDS if len(w) > 2), key=lambda w: (-len(w), w))))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule), by start, without overlaps."""
    found, stop = [], 0
    for m in RUN.finditer(text):
        start = m.start()
        while start > stop and text[start - 1] in RUN_CHARS:
            start -= 1
        stop = m.end()
        if stop - start >= LEAST:
            found.append((start, stop, "run"))
    found += _mixed_runs(text)
    given, stop = [], 0
    logins = [(m.start(1), m.end(1), "login") for m in LOGIN.finditer(text)]
    for m in SEPARATOR.finditer(text):
        if m.start() < stop or not CREDENTIAL_BEFORE.search(text, max(0, m.start() - 40), m.start()):
            continue
        value = QUOTED if m[1] else IN_QUERY if QUERY_BEFORE.search(text, max(0, m.start() - 40), m.start()) else BARE
        scheme = SCHEME.match(text, m.end())
        begin = scheme.end() if scheme else m.end()
        v = value.match(text, begin)
        end = v.end() if v else begin
        while end > begin and text[end - 1] in ".,;)":
            end -= 1
        if end - begin >= ASSIGNED:
            given.append((begin, end, "assigned"))
            stop = end
    return sorted(_apart(_apart(logins, given), found))


def _apart(first: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``first``, by start and without overlaps, and those of ``more`` that overlap none of them, by start."""
    ends = [c[1] for c in first]
    found = list(first)
    for c in more:
        k = bisect_right(ends, c[0])  # the first that ends beyond the start
        if k == len(first) or first[k][0] >= c[1]:
            found.append(c)
    return sorted(found)


def _mixed_runs(text: str) -> list[tuple[int, int, str]]:
    """Runs without a digit that go from lower to upper case ``HUMPS`` times or more."""
    out, stop = [], 0
    for m in HUMP.finditer(text):
        if m.start() < stop:
            continue
        start, stop = m.start(), m.end()
        while start > 0 and text[start - 1] in RUN_CHARS:
            start -= 1
        while stop < len(text) and text[stop] in RUN_CHARS:
            stop += 1
        run = text[start:stop]
        if len(run) >= LEAST and len(HUMP.findall(run)) >= HUMPS and not any(c in DIGITS for c in run) and not any(k in run for k in ISSUED):
            out.append((start, stop, "run"))
    return out


FEATURES = "length distinct entropy digits upper lower symbols transitions hex longest_run dictionary vowels path_parts in_path credential benign assigned quoted uuid issued all_digits login scheme placeholder words".split()


def features(text: str, start: int, end: int) -> list[float]:
    value, n = text[start:end], end - start
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value)
    count = Counter(value)
    runs = re.findall("d+|u+|l+|s+", kinds)
    letters = [c for c in value.lower() if c.isalpha()]
    covered = sum(m.end() - m.start() for m in DICTIONARY.finditer(value.lower()))
    near = [w.lower() for w in NEIGHBOUR.findall(before)[-3:]]
    around = near + [w.lower() for w in NEIGHBOUR.findall(after)[:2]]
    return [
        math.log2(n), len(count) / n, -sum(k / n * math.log2(k / n) for k in count.values()),
        *(kinds.count(k) / n for k in "duls"), (len(runs) - 1) / n, float(all(c in "0123456789abcdefABCDEF-" for c in value)), max(map(len, runs)) / n,
        covered / max(1, len(letters)), sum(c in "aeiou" for c in letters) / max(1, len(letters)),
        value.count("/"), float(bool(re.search("[/\\\\]$|://\\S*$", before)) or bool(re.match("[/\\\\]|\\.[a-z]{2,4}\\b", after))),
        sum(w in CREDENTIAL for w in near), sum(w in BENIGN for w in around), float(bool(re.search("[:=][ \\t]{0,3}[\"'`]?$", before))),
        float(before[-1:] in "\"'`" and before != ""), float(bool(UUID.fullmatch(value))), float(value.startswith(ISSUED)), float(value.isdigit()),
        float(after[:1] == "@" and bool(LOGIN_BEFORE.search(before))), float(bool(SCHEME_BEFORE.search(before))), float(bool(PLACEHOLDER.search(value))), sum(len(w) > 2 for w in re.split("[^a-z]+", value.lower())),
    ]


def labelled_findings(n: int = SAMPLE, seed: int = SEED) -> list[tuple[str, int, int, bool]]:
    """(text, start, end, secret): findings as credentials and their look-alikes are written, half of each."""
    r = random.Random(seed)
    digits, hexa, alnum = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    raw = lambda k: base64.b64encode(r.randbytes(k)).decode()
    syllables = "the ing er on tion ly en ver que ment sch keit os ado ci th ou re an un de el".split()
    prose = lambda k: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(k))
    # Names that the features' lists don't hold, beside those that they do.
    keys = "token api_key secret password pwd access_token auth_token private_key client_secret bearer db_pass signing_key webhook_secret master_key psk pin_code smtp_password encryption_key service_token root_pw".split()
    marks = [*BENIGN, *"batch parcel render cachekey device ticket article node shard fingerprint snapshot manifest cursor part slug asset job ledger lot".split()]
    keyed = lambda v: r.choice(['{k} = "{v}"', "{k}: {v}", "{k}={v}", '"{k}": "{v}"', "{k} = '{v}'", "{k} is {v}", "https://site.example/path?id=3&{k}={v}&page=2", "Server=db;Uid=app;{k}={v};"]).format(k=r.choice(keys), v=v)
    benign = lambda v: r.choice(["{k} {v}", "{k}: {v}", '{k} = "{v}"', "{k}={v}"]).format(k=r.choice(marks), v=v)
    mixed = lambda k: "".join(r.choice(alnum[:52]) for _ in range(k))
    login = lambda v: f"{r.choice(['postgres', 'mysql', 'amqp', 'redis', 'https', 'mongodb+srv', 'ftp'])}://{r.choice(['app', 'svc', 'root', 'ci-user', ''])}:{v}@{r.choice(['db', 'host.example', '10.0.0.5:5432', 'cache.internal/0'])}"
    scheme = lambda v: r.choice(["Authorization: {s} {v}", '"Authorization": "{s} {v}"', "-H 'Authorization: {s} {v}'", "auth={s} {v}", "{s} {v}"]).format(s=r.choice(["Bearer", "bearer", "Basic", "Token"]), v=v)
    phrase = lambda: r.choice(["", "-", "_", "."]).join(r.choice(WORDS) for _ in range(r.randint(3, 5)))
    camel = lambda: "".join(r.choice(WORDS).title() for _ in range(r.randint(4, 7)))
    blank = lambda: r.choice(["<{w}>", "${{{w}}}", "{{{{{w}}}}}", "your_{w}_here", "****{w}", "xxxxxxxx", "********", "changeme", "${w}", "%{w}%", "os.environ[{w}]", "process.env.{w}", "settings.{w}", "example-{w}", "[{w}...]", "insert_{w}"]).format(w=r.choice(["password", "token", "API_KEY", "secret", "DB_PASS", "value"]))
    issue = lambda: r.choice(ISSUED) + some(alnum, r.randint(16, 36))
    strong = lambda: r.choice([lambda: raw(r.randint(18, 48)), lambda: some(alnum, r.randint(20, 48)), lambda: mixed(r.randint(16, 40)), lambda: some(hexa, 40)])()
    password = lambda: r.choice([lambda: some(alnum + "!@#$%^&*", r.randint(9, 18)), lambda: some(alnum[26:52], r.randint(3, 8)) + some(digits, r.randint(3, 4)), lambda: some(alnum[26:52], r.randint(5, 8)) + some(digits, r.randint(1, 2)), lambda: some(alnum[26:52], r.randint(9, 14))])()
    out = []
    for k in range(n):
        secret = k % 2 == 0
        if secret:
            kind = r.choices(range(7), (5, 4, 3, 3, 2, 2, 2))[0]
            value = [strong, password, issue, strong, lambda: r.choice([password, strong])().replace("@", "!"), phrase, lambda: mixed(r.randint(18, 40))][kind]()
            shown = value if kind == 2 and r.random() < 0.4 or kind == 6 and r.random() < 0.5 else scheme(value) if kind == 3 else login(value) if kind == 4 else keyed(value)
        else:
            kind = r.randrange(12)
            value = [lambda: some(hexa, r.choice([32, 40, 64])), lambda: str(uuid.UUID(bytes=r.randbytes(16))), lambda: some(digits, r.randint(16, 20)), lambda: "/".join(r.choice(WORDS) for _ in range(4)) + some(digits, 2), lambda: "_".join(r.choice(WORDS) for _ in range(3)) + some(digits, 2) + "_" + r.choice(WORDS), lambda: r.choice(["your_api_key_here_1", "xxxxxxxxxxxxxxxx0000", "changeme-example-1234", "0000000000000000", "placeholder-token-123", "AAAAAAAAAAAAAAAAAAAA1"]), lambda: prose(1) * 4 + "-" + some(digits, 3), lambda: "-".join([str(r.randint(1990, 2030)), some(digits, 2), some(digits, 2), r.choice(WORDS), r.choice(WORDS)]), blank, camel, lambda: r.choice([w for w in WORDS if len(w) > 5]), blank][kind]()
            shown = benign(value) if kind in (0, 1) else keyed(value) if kind in (5, 8, 10) else r.choice([login, scheme])(value) if kind == 11 else r.choice([benign, str, str])(value)
        left, right = prose(r.randint(0, 12)), prose(r.randint(0, 12))
        text = f"{left} {shown} {right}".strip()
        start = text.rindex(value, 0, len(left) + len(shown) + 2)
        out.append((text, start, start + len(value), secret))
    return out


class Forest:
    """Trees as arrays: feature (-1 at a leaf), limit, left, right, share of secrets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], rng))

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes, todo = [[-1, 0.0, -1, -1, float(y.mean())]], [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            share = y[rows].mean()
            nodes[node][4] = float(share)
            if depth == DEEP or len(rows) < 2 * LEAF or share in (0, 1):
                continue
            best = (0.0, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, t = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(order) + 1)
                gain = t**2 / n + np.r_[((t[-1] - t[:-1]) ** 2) / (len(order) - n[:-1]), 0] - t[-1] ** 2 / len(order)
                gain[v == np.r_[v[1:], v[-1]]] = -1  # no cut between equal values
                gain[: LEAF - 1], gain[len(gain) - LEAF :] = -1, -1
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), int(f), float(v[k] + v[k + 1]) / 2)
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                nodes[node][:4] = [best[1], best[2], len(nodes), len(nodes) + 1]
                nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
                todo += [(nodes[node][2], rows[low], depth + 1), (nodes[node][3], rows[~low], depth + 1)]
        kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
        return tuple(np.array(c, t) for c, t in zip(zip(*nodes, strict=True), kinds, strict=True))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, limit, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                low = x[np.arange(len(x)), feature[at]] <= limit[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def train(findings: list[tuple[str, int, int, bool]] | None = None) -> Forest:
    findings = labelled_findings() if findings is None else findings
    return Forest(np.array([features(t, s, e) for t, s, e, _ in findings]), np.array([float(x[3]) for x in findings]))


def scan(texts: list[str], forest: Forest) -> list[list[tuple[int, int, str, float]]]:
    """Of each text its findings (start, end, rule, score); positions in code points."""
    found = [candidates(t) for t in texts]
    rows = [features(t, s, e) for t, c in zip(texts, found, strict=True) for s, e, _ in c]
    scores = iter(forest.scores(np.array(rows)).tolist() if rows else [])
    return [[(s, e, rule, next(scores)) for s, e, rule in c] for c in found]


def find_secrets(docs: DataFrame, findings: list[tuple[str, int, int, bool]] | None = None) -> DataFrame:
    """One row per candidate: doc_id, start_at, end_at (exclusive), rule, score, is_secret, value_sha256."""
    forest = train(findings)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            rows = [
                (i, s, e, rule, round(score, 6), score >= ACCEPT, hashlib.sha256(t[s:e].encode()).hexdigest())
                for i, t, c in zip(ids, own, scan(own, forest), strict=True) for s, e, rule, score in c
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, KINDS, strict=True)], NAMES)

    return texts(docs).mapInArrow(each, "doc_id long, start_at long, end_at long, rule string, score double, is_secret boolean, value_sha256 string")


NAMES = ["doc_id", "start_at", "end_at", "rule", "score", "is_secret", "value_sha256"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.string()]


def redact(docs: DataFrame, findings: list[tuple[str, int, int, bool]] | None = None) -> DataFrame:
    """All documents, secrets in their texts replaced by ``REDACTED``; n_chars, if there is one, follows the text."""
    forest, schema = train(findings), docs.schema
    small_batches(docs.sparkSession)
    counted = "n_chars" in docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["text"].to_pylist()
            new = list(own)
            for k, spans in enumerate(scan([t or "" for t in own], forest)):
                real = [(s, e) for s, e, _, score in spans if score >= ACCEPT]
                if real:
                    gaps = zip([0, *(e for _, e in real)], [*(s for s, _ in real), None], strict=True)
                    new[k] = REDACTED.join(own[k][a:b] for a, b in gaps)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(new, batch.schema.field("text").type)
            if counted:
                sizes = [c if t is o else len(t) for c, t, o in zip(batch["n_chars"].to_pylist(), new, own, strict=True)]
                columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(each, schema)
