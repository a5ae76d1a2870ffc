"""URL filter: rules by host and path, else a logistic regression on hashed character n-grams of host and path.

DataFrame expressions alone. The model is trained in the dual: with a few hundred labelled URLs the gradient descent on
``n`` coefficients and the (n x n) matrix of shared n-grams is one array expression over one row, and gives the same
weights as descent on the hashed features. The weights (one per bucket) then score any URL by array look-up.

Labelled URLs are a parameter, at most :data:`MOST` of them; :data:`LABELLED` is a small table made for this library from
common words of either kind of site. The default threshold blocks at a probability above one half.

Defined results: null urls and urls without ``://`` have empty host and path; no rule fits them, and the model's
verdict on the empty string is theirs; repeated rows are judged alike; extra columns are ignored; the work for a URL is
proportional to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

BUCKETS = 4096
SIZES = (3, 4)
STEPS, RATE, RIDGE = 600, 10.0, 0.0002

#: (host, path, verdict); the longest fitting rule wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Labelled URLs at most: their matrix is one row of one task.
MOST = 2000

_SITES = "blog www m shop news docs en mail forum static".split()
#: Words of hosts by kind, and words that go with either.
_BAD = """casino poker slots roulette jackpot lottery betting bets gambling viagra cialis pharmacy pills meds steroids porn xxx
sex adult escorts cams dating warez torrents malware phishing spam clickbait ads adserver tracking affiliate loans payday
replica followers""".split()
_GOOD = """library museum university college school hospital clinic garden weather recipes kitchen bakery travel hiking cycling
railway history science physics biology chemistry astronomy language grammar archive records council parliament police
water forest river mountain village town county journal magazine gazette theatre opera cinema gallery painting pottery
knitting carpentry insurance bank research institute foundation society church festival concert football tennis chess
sailing fishing horses birds insects trees farming dairy market grocery furniture clothing children family health
nutrition dentist nursing economics justice software hardware kernel compiler database network protocol""".split()
_EITHER = "free best online top my the live real big world daily click win buy hot new fast shop club direct".split()


def _names(words: list[str], each: int) -> list[str]:
    """Each word with others of its kind and with words of either, joined in several ways."""
    out = []
    for i, w in enumerate(words):
        other, either, last = words[(5 * i + 3) % len(words)], _EITHER[i % len(_EITHER)], _EITHER[(7 * i + 2) % len(_EITHER)]
        out += [f"{w}-{other}", f"{either}{w}", f"{w}-{last}s", f"{either}-{w}-{i}"][:each]
    return out


_PATHS = ["/en/825?page=2", "/de/12.html", "/fr/404/", "/es/77", "/", "/about", "/en/9#top", "/post/2021/03/title"]


def _labelled() -> list[tuple[str, str, int]]:
    out = []
    for label, names in ((1, _names(_BAD, 4)), (0, _names(_GOOD, 3))):
        for i, name in enumerate(names):
            host = (f"{name}.example.{{}}" if i % 2 else f"{_SITES[i % len(_SITES)]}.{name}.{{}}").format(("com", "org", "net")[i % 3])
            out.append((name, f"https://{host}{_PATHS[i % len(_PATHS)]}", label))
    return out


#: (name in the host, url) of the labelled rows, and the rows: (url, 1 to block), a few hundred.
NAMED = [(name, url) for name, url, _ in _labelled()]
LABELLED = [(url, label) for _, url, label in _labelled()]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#``
    or the end."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"(?s)\A[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host or a subdomain, and a prefix of the path): its text and verdict, else null."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _buckets(prefix: str, part: Column, buckets: int, sizes) -> Column:
    """Buckets of all n-grams of ``part``. It is split into characters once (bound as an element of a one-element array),
    so that the work is proportional to its length."""

    def grams(chars: Column, n: int) -> Column:
        count = F.size(chars) - (n - 1)
        at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        rest = [F.lit("")] * (4 - n)
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(prefix), *[F.element_at(chars, i + k) for k in range(n)], *rest), F.lit(buckets)))

    return F.flatten(F.transform(F.array(F.split(part, "")), lambda chars: F.concat(*[grams(chars, n) for n in sizes])))


def features(host: Column, path: Column, buckets: int = BUCKETS, sizes=SIZES) -> Column:
    """The distinct buckets (from 0) of the character n-grams (of 1 to 4) of host and path; digits are one class."""
    made = []
    for prefix, part in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        made.append(_buckets(prefix, F.regexp_replace(part, "[0-9]+", "0"), buckets, sizes))
    return F.array_distinct(F.concat(*made))


def train(spark: SparkSession, labelled=None, buckets: int = BUCKETS, sizes=SIZES, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> list[float]:
    """The weight of each bucket, then the bias. Features are scaled to unit length, so equal work is done for long and
    short URLs."""
    labelled = LABELLED if labelled is None else labelled
    if len(labelled) > MOST:
        raise ValueError(f"{len(labelled)} labelled URLs; {MOST} at most")
    if not labelled:
        return [0.0] * (buckets + 1)
    urls = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("y")) for u, y in labelled])
    rows = spark.range(1).select(F.posexplode(urls).alias("i", "x")).select("i", "x.url", "x.y")
    host, path = host_path(F.col("url"))
    rows = rows.select("i", "y", host.alias("host"), path.alias("path")).select("i", "y", features(F.col("host"), F.col("path"), buckets, sizes).alias("f"))
    # One row, sorted by i: as many elements as there are labelled URLs, MOST at most.
    one = written(rows, "urls").groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "y", "f"))).alias("x"))
    zero = F.lit(0.0)
    unit = lambda a: F.sqrt(F.size(a["f"]).cast("double"))
    shared = lambda a, b: F.size(F.array_intersect(a["f"], b["f"])) / (unit(a) * unit(b)) + 1.0
    one = one.withColumn("k", F.transform("x", lambda a: F.transform("x", lambda b: shared(a, b))))
    one = written(one, "shared")  # else the optimiser would put the matrix's expression into every step
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), zero, lambda s, v: s + v)
    n = len(labelled)

    def step(alpha: Column, _: Column) -> Column:
        moved = F.zip_with(F.transform(F.col("k"), lambda row: dot(row, alpha)), F.col("x"), lambda z, a: 1 / (1 + F.exp(-z)) - a["y"])
        return F.zip_with(alpha, moved, lambda old, g: old * (1 - rate * ridge) - g * (rate / n))

    start = F.transform("x", lambda a: zero)
    one = one.select("x", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("alpha"))
    one = written(one, "alpha")
    pairs = F.explode(F.arrays_zip("x", "alpha")).alias("e")
    each = one.select(pairs).select((F.col("e.alpha") / F.sqrt(F.size("e.x.f"))).alias("w"), F.col("e.alpha").alias("b"), F.col("e.x.f").alias("f"))
    weights = {r[0]: r[1] for r in each.select(F.explode("f").alias("bucket"), "w").groupBy("bucket").agg(F.sum("w")).collect()}
    bias = each.agg(F.sum("b")).first()[0]
    return [weights.get(b, 0.0) for b in range(buckets)] + [bias]


def probability(host: Column, path: Column, weights: list[float], sizes=SIZES) -> Column:
    buckets = len(weights) - 1
    table = F.array(*[F.lit(w) for w in weights[:-1]])
    f = features(host, path, buckets, sizes)
    # The features are bound once, as an element of a one-element array, for their sum and their length.
    z = F.element_at(F.transform(F.array(f), lambda a: F.aggregate(a, F.lit(0.0), lambda s, b: s + F.element_at(table, (b + 1).cast("int"))) / F.sqrt(F.greatest(F.size(a), F.lit(1)))), 1)
    return 1 / (1 + F.exp(-(z + F.lit(weights[-1]))))


def judge(pages: DataFrame, weights: list[float], rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, probability`` for every row of ``pages``: a projection, no shuffle."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "probability": probability(F.col("host"), F.col("path"), weights)})
    own = F.when(F.col("probability") > threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "probability")
