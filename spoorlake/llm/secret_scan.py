"""Secret scan: candidate strings, and a random forest that removes the false positives.

Candidates, found in whole texts, are runs of 16 or more token characters with a digit or both cases, values of any
length and of their own characters after a credential word and a delimiter, and private-key blocks. The forest sees a
candidate's length, character transitions (between classes, and under a table of letter pairs of the dictionary),
dictionary coverage, the path (whether it is part of a path or URL, and hints in the row's own path) and the words
around it. It is grown on labelled findings: a parameter; :data:`LABELLED` is a table made for this library by a fixed
seed. Growing takes place on the driver, on a few thousand rows; scanning is a map over the rows without a shuffle.

Defined results: null and empty texts have no findings; repeated rows have theirs each; a null ``doc_id`` or path is
carried as it is; a candidate may be as long as its text; extra columns, whatever their names, pass or are ignored. Without labelled findings
of both kinds nothing is called false: every candidate is a secret.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, release, texts_of

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.~\-]{16,}")
#: A value after a credential word (or a longer name that ends in one) and a delimiter: quoted up to its quote, else up to white space.
ASSIGNED = re.compile(
    r"""(?i)(?:(?<![a-z])key|(?:access|secret|private|api)[_-]?key|credentials?|authorization|pass(?:word|wd|phrase)|pwd|secret|token|bearer|auth)"""
    r"""["'`]?\s*(?:=>|:=|[=:])\s*(?:(?:basic|bearer)\s+)?(?:"([^"\n]+)"|'([^'\n]+)'|`([^`\n]+)`|([^\s"'`]+))"""
)
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----.*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----", re.S)
MARK = "[SECRET]"
WINDOW = 48
THRESHOLD = 0.5
TREES, DEPTH = 40, 9

_HOT = "token secret password passwd pwd apikey api_key key auth authorization bearer credential credentials private access access_key secret_key client_secret session".split()
_COLD = "commit sha sha1 sha256 md5 checksum digest hash revision rev uuid guid etag fingerprint example version build id blob tree object image integrity release".split()
_WORDS = """about after again also although always another application area argument around array available based because
before between block build button cache call change character check class client close code collection column command
comment common complete component config connect contain content context control count create current data database date
default define delete description design detail develop device different directory display document does during each edit
element email enable end entry error event every example exist export extend false field file filter find first folder
following format found frame from function general generate get global group handle have header help high home host html
http image import include index information input install instance interface internal item java javascript keep kind
language large last length level library license line link list load local location login main make manager manage map
match media member memory menu message method model module more most move name native network next node none not note
null number object offset only open operation option order other output over package page parameter parent part path
pattern people permission place plugin point policy port position post present previous print private process product
profile program project property protocol provider public query queue read record reference region register release
remote remove render replace report request require reset resource response rest result return root route row rule
sample save scale schema screen script search section select send server service session setting shared should show
simple single site size source space special start state static status step stop storage store stream string structure
style submit support switch system table target task template test text theme there these thing this thread through time
title token tool total track transaction transform tree true type under unit update upload url user using utility valid
value variable vendor version video view virtual visible wait web when where which while widget width will window with
without word work world write your and the for are was that his her she you all any can had one our out day use how its
new now old see two way who boy did let put say too und der die das nicht auch sich eine für mit les des une est dans
pour que sur pas par los las una del con para como más ing tion ment ness able""".split()


def _pairs() -> np.ndarray:
    table = np.full((27, 27), 0.2)
    index = lambda c: ord(c) - 96 if "a" <= c <= "z" else 0
    for w in _WORDS:
        for a, b in zip(w, w[1:]):
            table[index(a), index(b)] += 1
    return np.log(table / table.sum(1, keepdims=True))


_PAIRS = _pairs()
_DICTIONARY = re.compile("|".join(sorted((re.escape(w) for w in set(_WORDS) if len(w) > 2), key=len, reverse=True)))
_CLASS = np.full(256, 3, np.int64)
for _k, _chars in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits)):
    _CLASS[[ord(c) for c in _chars]] = _k
_SPLIT = re.compile(r"[^a-z0-9_]+")
NAMES = """length log_length digits upper symbols hex distinct entropy changes pair_score coverage longest_word slashes dots dashes
in_url uuid quoted assigned hot_before cold_before hot_near cold_near cold_path prefix""".split()


def features(text: str, start: int, end: int, path: str | None) -> list[float]:
    """Of the candidate ``text[start:end]`` in a row with ``path``."""
    s = text[start:end]
    raw = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
    n, kinds, low = len(s), _CLASS[raw], s.lower()
    counts = np.bincount(raw, minlength=128)
    share = counts[counts > 0] / n
    letters = np.frombuffer(low.encode("ascii", "replace")[:n].ljust(n, b"?"), np.uint8).astype(np.int64) - 96
    letters[(letters < 1) | (letters > 26)] = 0
    both = (letters[1:] > 0) & (letters[:-1] > 0)
    score = float(_PAIRS[letters[:-1][both], letters[1:][both]].mean()) if both.any() else -5.0
    found = _DICTIONARY.findall(low)
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    close = _SPLIT.split(before.lower())[-4:]
    near = set(_SPLIT.split(before.lower())) | set(_SPLIT.split(after.lower()))
    hint = set(_SPLIT.split((path or "").lower()))
    tail = before.rstrip(" \t\"'`")
    return [
        n, math.log(n), (kinds == 2).mean(), (kinds == 1).mean(), (kinds == 3).mean(), sum(c in "0123456789abcdef" for c in low) / n, len(share) / n,
        float(-(share * np.log2(share)).sum()), float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0, score, sum(map(len, found)) / n, max(map(len, found), default=0) / n,
        s.count("/"), s.count("."), s.count("-") + s.count("_"), float("://" in before[-10:] or "www." in low or before.endswith("@") or after.startswith("@")),
        float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))), float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before)), float(tail.endswith(("=", ":", "=>"))),
        sum(any(c.endswith(w) for c in close) for w in _HOT), sum(w in close for w in _COLD), sum(w in near for w in _HOT), sum(w in near for w in _COLD),
        float(bool(hint & {"test", "tests", "example", "examples", "fixture", "docs", "lock"})), float(bool(re.match(r"(ghp_|gho_|sk_|pk_|akia|xox[bp]-|eyj|aiza|glpat-)", low))),
    ]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Places, by start and without overlaps: private-key blocks, values after a credential word, and runs of token
    characters, without trailing stops, with a digit or both cases."""
    taken = [m.span() for m in KEY_BLOCK.finditer(text)]
    inside = lambda a, b, spans: any(x < b and a < y for x, y in spans)
    blocks = len(taken)
    for m in ASSIGNED.finditer(text):
        a, b = m.span(m.lastindex)
        while m.lastindex == 4 and b > a + 1 and text[b - 1] in ".,;)]}>":
            b -= 1
        if not inside(a, b, taken[:blocks]):
            taken.append((a, b))
    runs, k = [], 0
    taken.sort()
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".-":
            b -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        s = text[a:b]
        if len(s) >= 16 and (any(c.isdigit() for c in s) or (s.lower() != s and s.upper() != s and not s.istitle())):
            runs.append((a, b))
    yield from sorted(taken + runs)


def _labelled(n: int = 2400, seed: int = 11) -> list[tuple[str, int, int, str | None, int]]:
    """(text, start, end, path, 1 for a secret): half secrets, half look-alikes, in prose of the word list."""
    r = random.Random(seed)
    hexa, base = "0123456789abcdef", string.ascii_letters + string.digits
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    plain, tops = [w for w in _WORDS if w.isascii()], "com org net io de fr co.uk example.com".split()
    words = lambda k: " ".join(r.choice(plain) for _ in range(k))

    def secret() -> tuple[str, str, str]:
        value = r.choice([
            lambda: pick(hexa, r.randint(20, 72)), lambda: pick(base, r.randint(20, 64)), lambda: pick(base + "+/", r.randint(24, 64)) + "=" * r.randint(0, 2),
            lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(base, 36), lambda: "sk_live_" + pick(base, 24),
            lambda: pick(base, 4) + pick(base + "!@#$%&*!@#$%&*", r.randint(4, 12)), lambda: r.choice(plain).title() + pick(string.digits, r.randint(2, 4)) + pick(base, r.randint(2, 5)), lambda: pick(string.ascii_lowercase, 16),
            lambda: "eyJ" + pick(base, 20) + "." + pick(base, 40) + "." + pick(base + "-_", 30), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(base, 24),
        ])()
        if r.random() < 0.04:
            kind, body = r.choice(["", "RSA ", "EC ", "OPENSSH "]), "\n".join(pick(base + "+/", 64) for _ in range(r.randint(2, 20)))
            return "", f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----", ""
        name = r.choice(["", "", "db_", "my", "app-"]) + r.choice(_HOT)
        before, after = r.choice([(f'{name} = "', '"'), (f"{name}='", "'"), (f"{name}: ", ""), (f'"{name}": "', '"'), (f"{name}=", ""), (f"Authorization: {name} ", ""), (f"the {name} is ", "")])
        return before, value, after

    def other() -> tuple[str, str, str]:
        kind = r.randrange(13)
        if kind == 0:
            return f"{r.choice(_COLD)} ", pick(hexa, r.randint(20, 64)), ""
        if kind == 1:
            return f"{r.choice(_COLD)}: ", pick(hexa, r.choice([32, 40, 64, 128])), r.choice(["", "  file.tar.gz"])
        if kind == 2:
            return f'{r.choice(["id", "uuid", "guid", "request"])}="', "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), '"'
        if kind == 3:
            return r.choice(["https://", "http://www."]), "/".join([f"{r.choice(plain)}.example.com", *(r.choice(plain) for _ in range(r.randint(1, 4))), pick(string.digits, 4)]), ""
        if kind == 4:
            return "in ", "/" + "/".join(r.choice(plain) for _ in range(r.randint(2, 5))) + f"/{r.choice(plain)}{r.randrange(10)}.py", ""
        if kind == 5:
            return "", "".join(r.choice(plain).title() for _ in range(r.randint(3, 5))) + r.choice(["", "2", "V1"]), "()"
        if kind == 6:
            return f"{r.choice(_HOT)} = \"", r.choice(["your-" + r.choice(plain) + "-goes-here-1", "xxxxxxxxxxxxxxxxxxxx1", "0000000000000000000000", "changeme-changeme-1", "<1234567890123456>"[1:-1], "EXAMPLE_" + r.choice(plain).upper() + "_TOKEN_1"]), '"'
        if kind == 7:
            return r.choice(["", "no. ", "tel ", "order ", "+"]), pick(string.digits, r.randint(16, 24)), ""
        if kind == 8:
            return "", f"{r.choice(plain)}.{r.choice(plain)}{r.randrange(100)}.{r.choice(plain)}.{r.choice(tops)}", ""
        if kind == 9:
            name, host = r.choice(plain) + r.choice(["", ".", "_"]) + r.choice(plain) + str(r.randrange(1000)), f"{r.choice(plain)}{r.choice(['', '-', '.'])}{r.choice(plain)}{r.randrange(30)}.{r.choice(tops)}"
            return r.choice([("", name, "@" + host), (name + "@", host, "")])
        if kind > 10:
            value = r.choice([
                lambda: r.choice(plain), lambda: r.choice(plain) + r.choice(["_", "-", "."]) + r.choice(plain), lambda: "${" + r.choice(plain).upper() + "}", lambda: f"<{r.choice(plain)}>", lambda: r.choice("*x.") * r.randint(3, 12),
                lambda: r.choice("changeme null none true false required optional string hidden secret password str None".split()), lambda: f"os.environ[{r.choice(plain).upper()}]", lambda: f"get_{r.choice(plain)}()", lambda: str(r.randrange(100)),
            ])()
            before, after = r.choice([("{} = \"", '"'), ("{}='", "'"), ("{}: ", ""), ("{}=", ""), ("{} = ", "")])
            return before.format(r.choice(["", "", "db_", "my", "app-"]) + r.choice(_HOT)), value, after
        return "", "-".join(r.choice(plain) for _ in range(r.randint(3, 6))) + f"-{r.randrange(100)}", ""

    out = []
    for i in range(n):
        before, value, after = secret() if i % 2 else other()
        head, tail = words(r.randint(0, 8)) + " ", " " + words(r.randint(0, 8))
        case = (lambda t: t.upper()) if r.random() < 0.15 else (lambda t: t)
        text = case(head + before + value + after + tail)
        start = len(head) + len(before)
        path = r.choice([None, "src/main.py", "app/settings.py", "deploy.env"]) if i % 2 or r.random() < 0.7 else r.choice(["tests/data.py", "docs/example.md", "package.lock"])
        out.append((text, start, start + len(value), path, i % 2))
    return out


#: Labelled findings: (text, start, end, path, 1 for a secret).
LABELLED = _labelled()


class Forest:
    """Random forest for two classes; a tree is four arrays: feature (-1: leaf), threshold, left child (right: +1), share."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, least: int = 4, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = []
        if len(y) and 0 < y.sum() < len(y):
            for _ in range(trees):
                at = rng.integers(0, len(y), len(y))
                self.trees.append(self._grow(x[at], y[at], depth, least, rng))

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = [[-1, 0.0, 0, y.mean()]]
        todo = [(0, np.arange(len(y)), depth)]
        tries = max(1, round(math.sqrt(x.shape[1])))
        while todo:
            node, rows, left = todo.pop()
            t = y[rows]
            if not left or len(rows) < 2 * least or t.min() == t.max():
                continue
            best = (1e-9, 0, 0.0)
            for f in rng.permutation(x.shape[1])[: tries + 1]:
                order = np.argsort(x[rows, f], kind="stable")
                v, ones = x[rows[order], f], np.cumsum(t[order])
                n = np.arange(1, len(v))
                ok = (v[1:] > v[:-1]) & (n >= least) & (len(v) - n >= least)
                if not ok.any():
                    continue
                a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(v) - n)
                gini = lambda p: p * (1 - p)
                gain = np.where(ok, gini(t.mean()) - (n * gini(a) + (len(v) - n) * gini(b)) / len(v), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], int(f), (v[k] + v[k + 1]) / 2)
            if not best[2] and best[0] <= 1e-9:
                continue
            low = x[rows, best[1]] <= best[2]
            nodes[node][:3] = [best[1], best[2], len(nodes)]
            for part in (rows[low], rows[~low]):
                nodes.append([-1, 0.0, 0, y[part].mean()])
                todo.append((len(nodes) - 1, part, left - 1))
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.ones(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                go = left[at] + (x[rows, np.maximum(feature[at], 0)] > threshold[at])
                at = np.where(inner, go, at)
            total += share[at]
        return total / len(self.trees)


def grow(labelled=None, **parameters) -> Forest:
    labelled = LABELLED if labelled is None else labelled
    x = np.array([features(t, a, b, p) for t, a, b, p, _ in labelled], float).reshape(len(labelled), len(NAMES))
    return Forest(x, np.array([r[4] for r in labelled], float), **parameters)


def findings(texts: list[str], paths: list[str | None], forest: Forest) -> list[list[tuple[int, int, float]]]:
    """Candidates ``(start, end, probability)`` of each text."""
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t)]
    x = np.array([features(texts[i], a, b, paths[i]) for i, a, b in places], float).reshape(len(places), len(NAMES))
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    for (i, a, b), p in zip(places, forest.probability(x).tolist()):
        out[i].append((a, b, p))
    return out


def scan(docs: DataFrame, forest: Forest, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, start, length, value_sha256, probability, is_secret`` for every candidate of every row; places are in
    characters (code points)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("value_sha256", pa.string()), ("probability", pa.float64()), ("is_secret", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in texts_of(batches):
            found = findings(texts, b.column("path").to_pylist(), forest)
            rows = [(d, s, e - s, hashlib.sha256(t[s:e].encode()).hexdigest(), p, p >= threshold) for d, t, f in zip(b.column("doc_id").to_pylist(), texts, found) for s, e, p in f]
            yield batch(schema, [*zip(*rows)] if rows else [[]] * 6)

    rows = docs.select("doc_id", "text", F.col(path).cast("string").alias("path"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, value_sha256 string, probability double, is_secret boolean")


def redact(docs: DataFrame, forest: Forest, path: str = "source", threshold: float = THRESHOLD, mark: str = MARK) -> DataFrame:
    """``docs`` with secrets replaced by ``mark``; ``n_chars``, where there is one, follows the changed texts. No row is
    dropped, and texts without secrets (null too) stay as they are."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series, paths: pd.Series) -> pd.Series:
        whole = [t or "" for t in texts]
        out = texts.copy()
        for i, found in enumerate(findings(whole, [*paths], forest)):
            parts, at = [], 0
            for a, b, p in found:
                if p >= threshold:
                    parts += [whole[i][at:a], mark]
                    at = b
            if at:
                out.iloc[i] = "".join([*parts, whole[i][at:]])
        release()
        return out

    # The row as one column: names of its own can't clash with those of docs.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    changed = docs.select(whole, clean(F.col("text"), F.col(path).cast("string")).alias("text"))
    columns = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        same = F.col("text").eqNullSafe(F.col("doc.text"))
        columns["n_chars"] = F.when(same, F.col("doc.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*[columns[c].alias(c) if c in columns else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
