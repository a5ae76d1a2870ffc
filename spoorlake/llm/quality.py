"""Quality classifier by hierarchical empirical Bayes.

A logistic regression on counts of a whole text (fitted on a bounded sample of labelled rows) gives each document a log
likelihood ratio. Sites are two levels, host and path within host: the expected good documents of a site are summed over
all its documents, and its rate is shrunk towards the level above (path to host, host to the whole corpus) by a prior
whose weight follows from the spread between sites (method of moments). Posterior log odds = likelihood ratio + log odds
of the path's shrunk rate. Sites are grouped aggregates with map-side sums, so one site may hold any share of all rows;
where rates go back to the rows, a hash of the row deals a site over ``SALTS`` keys.

Defined results: null and empty texts are judged as texts without words; null host or path is a site of its own; without
labels of both kinds the likelihood ratio is zero and every document is kept (posterior one half or the site's); labels
that are null or of unknown documents are ignored; repeated rows are judged alike; extra columns pass or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, erased, release, texts_of, written

#: Labelled rows that fit the classifier at most: those with the smallest hashes of their id.
SAMPLE = 20_000
THRESHOLD = 0.5
#: Bounds of a prior's weight, in documents.
PRIOR = (2.0, 1000.0)
#: Bound of the classifier's log likelihood ratio: no text alone is beyond all doubt.
MOST = 12.0
#: Keys that the rows of one site are dealt over when its rate is joined.
SALTS = 16

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\v\f\r",
    "stop": b".,;:'\"()-", "loud": b"!?", "mark": b"#$%&*@^~", "frame": b"|<>{}[]\\/=_+`",
}
NAMES = [*_CLASSES, "words", "word_length", "distinct", "repeated", "loud_words"]


def features(text: str) -> list[float]:
    """Shares of character classes, and of distinct, repeated and upper-case words, over the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw) + 1
    shares = [(len(raw) - len(raw.translate(None, c))) / n for c in _CLASSES.values()]
    words = raw.split()
    m = len(words)
    repeated = sum(map(bytes.__eq__, words, words[1:])) / m if m else 0.0
    loud = sum(map(bytes.isupper, words)) / m if m else 0.0
    return [*shares, float(np.log1p(m)), len(raw) / (m + 1) / 10, len(set(words)) / (m + 1), repeated, loud]


def feature_rows(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``doc_id, host, path, x`` for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in texts_of(batches):
            yield batch(schema, [b.column("doc_id"), b.column("host"), b.column("path"), [features(t) for t in texts]])
        release()

    rows = docs.select("doc_id", "text", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, x array<double>")


class Classifier:
    """Ridge logistic regression with squared terms, on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30):
        self.fitted = len(y) > 1 and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._inputs(x)
        w = np.zeros(z.shape[1])
        penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-9])
        for _ in range(rounds):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
            w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        self.w, rate = w, y.mean()
        self.prior = np.log(rate / (1 - rate))

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, z * z, np.ones((len(x), 1))])

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad."""
        if not self.fitted or not len(x):
            return np.zeros(len(x))
        return np.clip(self._inputs(x) @ self.w - self.prior, -MOST, MOST)


def _labels(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """From at most ``sample`` rows of :func:`feature_rows` that have a label ``quality`` of 0 or 1."""
    joined = rows.join(_labels(labels), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").select("x", "quality").limit(sample)
    found = joined.collect()
    return Classifier(np.array([r[0] for r in found], float).reshape(len(found), len(NAMES)), np.array([r[1] for r in found], float))


def fit_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The same from ``docs``. The labels to use are chosen first, by ids alone; they are ``sample`` rows at most, so
    they are sent to the texts, and only labelled texts are looked at."""
    known = _labels(labels).join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.join(F.broadcast(written(known, "known").select("doc_id")), "doc_id", "left_semi")
    nothing = F.lit(None).cast("string")
    return fit(feature_rows(chosen.select("doc_id", "text", nothing.alias("h"), nothing.alias("p")), "h", "p"), labels, sample)


def _ratio_udf(classifier: Classifier):
    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        x = np.array([features(t or "") for t in texts], float).reshape(len(texts), len(NAMES))
        release()
        return pd.Series(classifier.ratio(x))

    return ratio


def _ratio_of_features(classifier: Classifier):
    @F.pandas_udf("double")
    def ratio(x: pd.Series) -> pd.Series:
        return pd.Series(classifier.ratio(np.array([*x], float).reshape(len(x), len(NAMES))))

    return ratio


def _weight(sites: DataFrame, rate: Column) -> float:
    """The prior's weight m = q(1-q)/t - 1 of a beta distribution whose variance t is what the sites' rates differ by
    beyond what sampling explains. ``sites``: n, s (expected good documents) and the rate of the level above."""
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - rate, 2))
    noise = F.sum(rate * (1 - rate))
    r = sites.agg(spread.alias("spread"), noise.alias("noise"), F.sum("n").alias("n"), F.sum(F.col("n") * rate * (1 - rate)).alias("q")).first()
    if not r["n"]:
        return PRIOR[1]
    between = (r["spread"] - r["noise"]) / r["n"]
    return float(np.clip((r["q"] / r["n"]) / between - 1, *PRIOR)) if between > 0 else PRIOR[1]


def site_rates(scored: DataFrame) -> tuple[float, DataFrame]:
    """The corpus rate and ``host, path, host_rate, path_rate``, from ``host, path, ratio`` of every document."""
    p = 1 / (1 + F.exp(-F.col("ratio")))
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    corpus = min(max(total["s"] / total["n"], 0.001), 0.999) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    m = _weight(hosts, F.lit(corpus))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + m * corpus) / (F.col("n") + m)).alias("host_rate"))
    both = written(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "sites")
    k = _weight(both, F.col("host_rate"))
    return corpus, both.select("host", "path", "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))


def _posterior() -> Column:
    return 1 / (1 + F.exp(-(F.col("ratio") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` (host, path, salt) with their site's rates. Spark broadcasts the sites if they turn out to be few."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s")
    rates = written(rates, "rates").select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_rate", "path_rate", salts)
    same = F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")) & (F.col("salt") == F.col("_s"))
    return rows.join(rates, same, "left").drop("_h", "_p", "_s", "salt")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, host, path, ratio, host_rate, path_rate, posterior, keep`` for every row of ``docs``."""
    rows = written(feature_rows(docs, host, path), "features")
    classifier = fit(rows, labels, sample)
    scored = written(rows.select("doc_id", "host", "path", F.pmod(F.xxhash64("doc_id", "x"), F.lit(SALTS)).cast("int").alias("salt"), _ratio_of_features(classifier)("x").alias("ratio")), "ratios")
    erased(rows)
    _, rates = site_rates(scored)
    out = _with_rates(scored, rates).withColumn("posterior", _posterior())
    return out.select("doc_id", "host", "path", "ratio", "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with their columns. Each text's ratio is computed once and
    stored with its row; texts are shuffled only if there are too many sites to broadcast."""
    classifier = fit_texts(docs, labels, sample)
    # Own names beside the columns of docs, whatever those are called.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int").alias("salt")
    inner = docs.select(whole, F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), salt, _ratio_udf(classifier)("text").alias("ratio"))
    stored = written(inner, "ratios")
    _, rates = site_rates(stored.select("host", "path", "ratio"))
    return _with_rates(stored, rates).where(_posterior() >= threshold).select("doc.*")
