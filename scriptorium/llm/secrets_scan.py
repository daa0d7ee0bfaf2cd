"""Secret scans with a random forest that removes false positives.

Patterns find candidates in whole texts.  A random forest, trained from
labelled findings, judges each by its length, its character transitions, how
much of it dictionary words cover, its path, and the words beside it.  The
forest's share of votes is the score of the finding.

``findings`` is one pass over the documents without a shuffle.  The forest is
a few arrays of fixed size and travels with the function.

Labelled findings have the columns ``candidate``, ``path``, ``before``,
``after`` and ``label``; at most ``max_findings`` rows (the smallest hashes)
are used.  Where no findings are labelled by hand, :func:`planted_findings`
labels them by contract: random values in the public format of every kind
(label 1) and look-alikes such as placeholders, words, repeats, sequences and
checksums (label 0) are planted into passages cut from the corpus, at most
``max_contexts`` of them, from documents that are not held out.

Defined results: null and empty texts have no candidates; very long runs are
one candidate, judged whole; overlapping candidates are reported once (the
first pattern wins); repeated rows give repeated results; extra columns pass
through if named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held_out

# Public formats of credentials, with a literal that stands in every match.
PATTERNS = {
    "aws_access_key": (r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])", ("AKIA", "ASIA")),
    "github_token": (r"(?<![A-Za-z0-9])(?P<v>gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})", ("gh",)),
    "gitlab_token": (r"(?<![A-Za-z0-9])(?P<v>glpat-[A-Za-z0-9_-]{20,})", ("glpat-",)),
    "slack_token": (r"(?<![A-Za-z0-9])(?P<v>xox[abprs]-[A-Za-z0-9-]{10,})", ("xox",)),
    "stripe_key": (r"(?<![A-Za-z0-9])(?P<v>[rs]k_(?:live|test)_[A-Za-z0-9]{16,})", ("k_live_", "k_test_")),
    "google_api_key": (r"(?<![A-Za-z0-9])(?P<v>AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])", ("AIza",)),
    "npm_token": (r"(?<![A-Za-z0-9])(?P<v>npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])", ("npm_",)),
    "sendgrid_key": (r"(?<![A-Za-z0-9])(?P<v>SG\.[A-Za-z0-9_-]{16,64}\.[A-Za-z0-9_-]{16,64})", ("SG.",)),
    "twilio_key": (r"(?<![A-Za-z0-9])(?P<v>SK[0-9a-f]{32})(?![A-Za-z0-9])", ("SK",)),
    "model_key": (r"(?<![A-Za-z0-9_-])(?P<v>sk-(?:[a-z0-9]{1,12}-){0,3}[A-Za-z0-9_-]{20,})", ("sk-",)),
    "account_key": (r"AccountKey=(?P<v>[A-Za-z0-9+/]{40,}={0,2})", ("AccountKey=",)),
    "authorization": (r"(?i:authorization)[\"']?\s{0,4}:\s{0,4}[\"']?(?i:bearer|basic|token)\s{1,4}(?P<v>[A-Za-z0-9._~+/=-]{16,})", (":",)),
    "json_web_token": (r"(?<![A-Za-z0-9])(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", ("eyJ",)),
    "private_key": (r"(?P<v>-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----)", ("-----BEGIN ",)),
    "url_password": (r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:(?P<v>[^\s:/@]{6,})@", ("://",)),
    "assignment": (r"(?i:token|secret|passwd|password|pwd|_pass|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s{0,8}(?:=|:|:=|=>)\s{0,8}[\"']?(?P<v>[^\"'\s,;]{8,})", ("=", ":")),
}
_SCAN = {k: (re.compile(p), words) for k, (p, words) in PATTERNS.items()}
_KINDS = list(PATTERNS)

# Words that tell of secrets, of examples, and common words.
SECRET_WORDS = ("token", "secret", "password", "passwd", "key", "credential", "auth", "login")
EXAMPLE_WORDS = ("example", "sample", "dummy", "test", "placeholder", "changeme", "fake", "mock", "commit", "sha", "checksum", "digest", "uuid")
DICTIONARY = ("the", "and", "for", "your", "here", "my", "this", "that", "pass", "word", "admin", "user", "name", "hello", "world", "change", "value", "none", "null", "true", "false", "default", "insert", "foo", "bar", "demo", "qwerty", "abc", "xxx", *SECRET_WORDS, *EXAMPLE_WORDS)
#: Characters of text on each side whose words are neighbours.
BESIDE = 48


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def coverage(candidate: str) -> float:
    """Share of the letters that dictionary words cover."""
    low = candidate.lower()
    held = bytearray(len(low))
    for word in DICTIONARY:
        at = low.find(word)
        while at >= 0:
            held[at : at + len(word)] = b"\x01" * len(word)
            at = low.find(word, at + 1)
    return sum(held) / max(1, len(low))


_ADDRESS = re.compile(r"\S*[A-Za-z0-9][.@/][A-Za-z0-9]\S*")
_RUN = re.compile(r"[A-Za-z0-9+/]+")


def words_beside(text: str) -> set[str]:
    """Whole lower-cased words, without those inside addresses."""
    return set(re.findall(r"[a-z]+", _ADDRESS.sub(" ", text).lower()))


FEATURES = ("length", "transitions", "kinds", "entropy", "longest_run", "digits", "upper", "hex_only", "steps", "coverage", "distinct", "secret_beside", "example_beside", "example_path", "assigned", "run_after")


def features(candidate: str, path: str, before: str, after: str) -> list[float]:
    n = max(1, len(candidate))
    kinds = [_kind(c) for c in candidate]
    counts = Counter(candidate)
    run = longest = 1
    for a, b in zip(candidate, candidate[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    beside = words_beside(f"{before} {after}")
    return [
        math.log(n),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        len(set(kinds)),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        longest,
        kinds.count(2) / n,
        kinds.count(1) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in candidate)),
        sum(ord(b) - ord(a) == 1 for a, b in zip(candidate, candidate[1:], strict=False)) / n,
        coverage(candidate),
        len(counts) / n,
        float(not beside.isdisjoint(SECRET_WORDS)),
        float(not beside.isdisjoint(EXAMPLE_WORDS)),
        float(any(w.rstrip("s") in EXAMPLE_WORDS for w in re.findall(r"[a-z]+", path.lower()))),
        float(before.rstrip()[-1:] in ("=", ":", '"', "'")),
        float(max(map(len, _RUN.findall(after)), default=0)),
    ]


class Forest:
    """Random forest of Gini trees, each grown on a bootstrap sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees: list[tuple[np.ndarray, ...]] = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows].astype(float), nodes, depth, least, rng)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))

    def _grow(self, x, y, nodes, depth, least, rng) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y.mean())])
        if depth and len(y) >= 2 * least and 0 < y.mean() < 1:
            best = None
            for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
                order = np.argsort(x[:, f], kind="stable")
                v, ones = x[order, f], np.cumsum(y[order])
                left = np.arange(1, len(y))
                cut = np.flatnonzero((v[1:] > v[:-1]) & (left >= least) & (len(y) - left >= least))
                if not len(cut):
                    continue
                nl, a = left[cut], ones[cut]
                nr, b = len(y) - nl, ones[-1] - a
                impurity = a * (nl - a) / nl + b * (nr - b) / nr
                i = int(np.argmin(impurity))
                if best is None or impurity[i] < best[0]:
                    best = (impurity[i], f, (v[cut[i]] + v[cut[i] + 1]) / 2)
            if best is not None:
                low = x[:, best[1]] <= best[2]
                nodes[at][:2] = [int(best[1]), float(best[2])]
                nodes[at][2] = self._grow(x[low], y[low], nodes, depth - 1, least, rng)
                nodes[at][3] = self._grow(x[~low], y[~low], nodes, depth - 1, least, rng)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, low, high, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                f = feature[at].astype(np.int64)
                to = np.where(x[rows, np.maximum(f, 0)] <= cut[at], low[at], high[at]).astype(np.int64)
                at = np.where(inner, to, at)
            total += value[at]
        return total / len(self.trees)


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _values(rng: random.Random) -> dict[str, tuple[Callable[[], str], Callable[[], str]]]:
    """For each kind a maker of random values and one of look-alikes, both
    with the text around them; the value stands between the marks."""
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    mixed, hexes = _UPPER + _LOWER + _DIGITS, "0123456789abcdef"
    word = lambda: rng.choice(DICTIONARY)

    def dull(k: int) -> str:
        """A value of k characters that nobody would draw at random."""
        made = rng.choice((pick("xX0A*", 1) * k, (_DIGITS * k)[:k], (_LOWER * k)[:k], ("".join(word() for _ in range(k)))[:k], ("EXAMPLE" * k)[:k], ("abc123" * k)[:k]))
        return made

    def framed(start: Callable[[], str], chars: str, size: Callable[[], int]) -> tuple[Callable[[], str], Callable[[], str]]:
        return (lambda: f"\x01{start()}{pick(chars, size())}\x02"), (lambda: f"\x01{start()}{dull(size())}\x02")

    name = lambda: rng.choice(("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "API_KEY", "SECRET", "pwd", "DB_PASS", "PRIVATE_KEY"))
    opens = lambda: rng.choice(((" = \"", "\""), ("=\"", "\""), (": '", "'"), (": ", ""), ("=", ""), (" = ", "")))

    def random_value() -> str:
        return rng.choice((lambda: pick(hexes, rng.choice((32, 40, 64))), lambda: pick(mixed + "+/", rng.randint(16, 64)), lambda: pick(mixed, rng.randint(12, 40)), lambda: pick(mixed + "!#$%^&*_-", rng.randint(10, 24))))()

    def plain_value() -> str:
        return rng.choice((lambda: "-".join((word(), word(), word())), lambda: f"<{word()}-{word()}>", lambda: "${" + word().upper() + "_" + word().upper() + "}", lambda: f"os.environ[{word()}]", lambda: f"get_{word()}_{word()}()", lambda: dull(rng.randint(8, 40)), lambda: pick(_LOWER, rng.randint(8, 11)), lambda: word() + word() + pick(_DIGITS, 3)))()

    def assigned(value: Callable[[], str]) -> Callable[[], str]:
        def made() -> str:
            left, right = opens()
            return f"{name()}{left}\x01{value()}\x02{right}"

        return made

    checksum = lambda: f"{rng.choice(('commit', 'sha', 'checksum', 'digest'))} {name()}: \x01{hashlib.sha1(pick(_LOWER, 6).encode()).hexdigest()}\x02"
    likeness = assigned(plain_value)
    key = lambda: rng.choice(("", "", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED "))
    head = lambda: rng.choice((f"-----BEGIN {key()}PRIVATE KEY-----",) * 5 + ("-----BEGIN PGP PRIVATE KEY BLOCK-----",))
    body = lambda: rng.choice((f"\n{pick(mixed + '+/', 47)}", f"\n{pick(mixed + '+/', 47)}", ""))
    web = mixed + "-_"
    return {
        "aws_access_key": framed(lambda: rng.choice(("AKIA", "ASIA")), _UPPER + _DIGITS, lambda: 16),
        "github_token": framed(lambda: f"gh{rng.choice('pousr')}_", mixed, lambda: 36),
        "gitlab_token": framed(lambda: "glpat-", web, lambda: 20),
        "slack_token": framed(lambda: f"xox{rng.choice('abprs')}-", mixed, lambda: rng.randint(24, 60)),
        "stripe_key": framed(lambda: rng.choice(("sk_live_", "rk_live_")), mixed, lambda: rng.randint(24, 34)),
        "google_api_key": framed(lambda: "AIza", web, lambda: 35),
        "npm_token": framed(lambda: "npm_", mixed, lambda: 36),
        "sendgrid_key": (lambda: f"\x01SG.{pick(web, 22)}.{pick(web, 43)}\x02", lambda: f"\x01SG.{dull(22)}.{dull(43)}\x02"),
        "twilio_key": framed(lambda: "SK", hexes, lambda: 32),
        "model_key": framed(lambda: rng.choice(("sk-", "sk-proj-", "sk-live-")), mixed, lambda: rng.randint(24, 48)),
        "account_key": (lambda: f"DefaultEndpointsProtocol=https;AccountName={pick(_LOWER, 8)};AccountKey=\x01{pick(mixed + '+/', 86)}==\x02;", lambda: f"AccountName={word()};AccountKey=\x01{dull(60)}\x02;"),
        "authorization": (lambda: f"Authorization: {rng.choice(('Bearer', 'Basic', 'token'))} \x01{pick(web, rng.randint(24, 60))}\x02", lambda: f"Authorization: Bearer \x01{rng.choice((dull(30), 'your-token-goes-here', 'access-token-value'))}\x02"),
        "json_web_token": (
            lambda: f"\x01eyJ{pick(web, rng.randint(15, 40))}.eyJ{pick(web, rng.randint(20, 200))}.{pick(web, 43)}\x02",
            lambda: rng.choice(("\x01eyJhbGciOiJIUzI1NiJ9.payload-here.signature-here\x02", f"\x01eyJ{dull(20)}.{dull(20)}.{dull(20)}\x02", f"\x01eyJheader-{word()}.payload-{word()}.signature\x02")),
        ),
        "private_key": (lambda: f"\x01{head()}\x02{body()}", lambda: f"\x01{head()}\x02\n{rng.choice(('example key', 'placeholder', 'dummy', 'test only', 'your key here, a sample'))}"),
        "url_password": (lambda: f"{rng.choice(('postgres', 'https', 'amqp', 'mysql'))}://{pick(_LOWER, 5)}:\x01{random_value()[:24].replace('/', 'x')}\x02@{pick(_LOWER, 6)}.internal", lambda: f"https://user:\x01{rng.choice(('password', 'changeme', 'your-pass', 'xxxxxxxx', '<password>'))}\x02@host"),
        "assignment": (assigned(random_value), lambda: likeness() if rng.random() < 0.85 else checksum()),
    }


def prose_contexts(n: int = 1500, seed: int = 5) -> list[tuple[str, str]]:
    """Made-up ``path, passage`` for fitting without a corpus."""
    rng = random.Random(seed)
    return [(rng.choice(("src", "web", "docs", "config", "")), " ".join("".join(rng.choice(_LOWER) for _ in range(rng.randint(2, 9))) for _ in range(16))) for _ in range(n)]


def corpus_contexts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", max_contexts: int = 1500) -> list[tuple[str, str]]:
    """``path, passage`` cut from the ``max_contexts`` documents of the smallest
    hashes that are not held out, each at a place that its hash chooses."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.xxhash64(F.col(id_col).cast("string"), text)
    place = (F.pmod(mark, F.greatest(F.length(text) - 2 * BESIDE, F.lit(1))) + 1).cast("int")
    rows = docs.where(~held_out(F.col(id_col))).select(mark.alias("mark"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.substr(text, place, F.lit(2 * BESIDE)).alias("passage"))
    return [(r["path"], r["passage"]) for r in rows.orderBy("mark", "path", "passage").limit(max_contexts).collect()]


def planted_findings(contexts: Sequence[tuple[str, str]], seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (candidate, path, before, after, label): two for each
    context and kind group, a value and a look-alike, the kinds taking turns.

    Half of the look-alikes stand in an example's path or beside an example's words.
    """
    rng = random.Random(seed)
    makers = _values(rng)
    turns = ["assignment", "private_key", *_KINDS]  # the kinds without a fixed frame need most examples
    out = []
    for i, (path, passage) in enumerate(contexts):
        kind = turns[i % len(turns)]
        cut = len(passage) // 2
        for label, make in zip((1, 0), makers[kind], strict=True):
            made, where, lead = make(), path, ""
            if not label and rng.random() < 0.5:
                where, lead = rng.choice(((rng.choice(("tests", "examples", "sample")), ""), (path, rng.choice(("for example ", "a sample: ", "dummy ", "fake ")))))
            start, end = made.index("\x01"), made.index("\x02")
            before = f"{passage[:cut]} {lead}{made[:start]}"[-BESIDE:]
            after = f"{made[end + 1:]} {passage[cut:]}"[:BESIDE]
            out.append((made[start + 1 : end], where, before, after, label))
    return out


def fit(labelled: DataFrame | Sequence[tuple] | None = None, max_findings: int = 20_000, seed: int = 11) -> Forest:
    """A forest from labelled findings, or from values planted in made-up prose."""
    if labelled is None:
        rows = planted_findings(prose_contexts())
    elif isinstance(labelled, DataFrame):
        columns = ("candidate", "path", "before", "after")
        clean = labelled.where("label is not null").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns], F.col("label").cast("int").alias("label"))
        rows = sorted(tuple(r) for r in clean.orderBy(F.xxhash64(*columns), *columns, "label").limit(max_findings).collect())
    else:
        rows = list(labelled)[:max_findings]
    return Forest(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows]), seed=seed)


def candidates(text: str) -> list[tuple[str, str, int, int]]:
    """Kind, value, start and end of each candidate, by place.

    Where two overlap, that of the earlier pattern stays.
    """
    out: list[tuple[str, str, int, int]] = []
    for kind, (pattern, words) in _SCAN.items():
        if any(w in text for w in words):
            for m in pattern.finditer(text):
                a, b = m.span("v")
                if all(b <= x or a >= y for _, _, x, y in out):
                    out.append((kind, m["v"], a, b))
    return sorted(out, key=lambda c: c[2])


_FINDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
RESULT = T.StructType([T.StructField("n_candidates", T.LongType()), T.StructField("n_findings", T.LongType()), T.StructField("findings", T.ArrayType(_FINDING))])


def scan(docs: DataFrame, forest: Forest, keep: Sequence[str] | None = None, text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """Add ``n_candidates``, ``n_findings`` and the ``findings`` (positions in
    characters) that score ``threshold`` or more."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.names]
    schema = T.StructType([docs.schema[c] for c in keep] + RESULT.fields)
    trees = forest.trees
    beside = max(docs.columns, key=len) + "_path"  # no other column has this name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Forest.__new__(Forest)
        here.trees = trees
        for batch in batches:
            found, rows = [], []
            for text, path in zip(batch[text_col], batch[beside].to_pylist(), strict=True):
                text = text.as_py() or ""
                mine = candidates(text)
                found.append(mine)
                rows += [features(v, path, text[max(0, a - BESIDE) : a], text[b : b + BESIDE]) for _, v, a, b in mine]
            scores = iter(here.predict(np.array(rows)).tolist() if rows else [])
            findings = [[{"kind": k, "start": a, "end": b, "score": round(s, 9)} for k, _, a, b in mine if (s := next(scores)) >= threshold] for mine in found]
            made = [pa.array([len(x) for x in found], pa.int64()), pa.array([len(x) for x in findings], pa.int64()), pa.array(findings, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *made], [*keep, *RESULT.names])

    rows = docs.select(*dict.fromkeys([*keep, text_col]), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias(beside))
    return rows.mapInArrow(run, schema)
