"""Exact Jaccard similarity joins of feature sets.

Candidates share a feature of their prefixes: with features ordered from rare to frequent, two sets of similarity t or
more must share one of the first n - ceil(t n) + 1. So frequent features, whose postings would be quadratic, are hardly
joined, no pair is lost, and there is no limit on postings. Features of one set alone come first in that order and are in
no intersection: they are counted, and then neither kept nor moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import small, written


def jaccard_pairs(sets: DataFrame, threshold_bp: int = 8000) -> DataFrame:
    """``a, b, intersection, union_size, similarity_bp`` with a < b for ``id, features`` (distinct features, one row an
    id) where intersection * 10000 >= threshold_bp * union. Empty sets are in no pair."""
    rows = sets.select("id", F.size("features").alias("n"), F.explode("features").alias("f"))
    shared = rows.withColumn("c", F.count("*").over(Window.partitionBy("f"))).where("c > 1")
    # An intersection of at least t times the union is one of at least t times each set.
    least = F.ceil(F.col("n") * threshold_bp / 10_000).cast("int")
    ordered = shared.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "f"))).alias("o")).where(F.size("o") >= least)
    ordered = written(ordered.select("id", "n", F.transform("o", lambda x: x["f"]).alias("features")), "sets")
    prefix = ordered.select("id", "n", F.size("features").alias("k"), F.posexplode(F.slice("features", F.lit(1), F.size("features") - least + 1)).alias("at", "f"))
    prefix = prefix.select("f", "id", "n", (F.col("k") - F.col("at")).alias("rest"))
    side = lambda p: prefix.select("f", *[F.col(c).alias(f"{c}_{p}") for c in ("id", "n", "rest")])
    # Sets whose first common feature is this one have no more in common than what is left of either.
    fits = F.least("rest_a", "rest_b") * (10_000 + threshold_bp) >= (F.col("n_a") + F.col("n_b")) * threshold_bp
    pairs = side("a").join(side("b"), "f").where((F.col("id_a") < F.col("id_b")) & fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    whole = lambda p: ordered.select(F.col("id").alias(p), F.col("n").alias(f"n{p}"), F.col("features").alias(f"f{p}"))
    both = pairs.join(whole("a"), "a").join(whole("b"), "b")
    both = both.withColumn("intersection", F.size(F.array_intersect("fa", "fb")).cast("long"))
    both = both.withColumn("union_size", (F.col("na") + F.col("nb") - F.col("intersection")).cast("long")).select("a", "b", "intersection", "union_size")
    both = both.where(F.col("intersection") * 10_000 >= F.col("union_size") * threshold_bp)
    return both.withColumn("similarity_bp", F.floor(F.col("intersection") * 10_000 / F.col("union_size")).cast("long"))


#: Distinct query features up to which the rows are filtered by them before any shuffle.
FILTER_FEATURES = 500_000


def containment(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """``query, id, shared, n_query``: features that each row shares with each query (``query, features`` and ``id,
    features``), where there are any. Most rows share nothing: if the queries' features are few (they are counted), each
    row's are filtered by them where they are; else the same join shuffles them all."""
    q = written(queries.select("query", F.size("features").cast("long").alias("n_query"), F.explode("features").alias("f")), "queries")
    known = written(q.select("f").distinct(), "features")
    r = rows.select("id", F.explode("features").alias("f")).join(small(known, FILTER_FEATURES), "f", "left_semi")
    return r.join(q, "f").groupBy("query", "id").agg(F.count("*").alias("shared"), F.first("n_query").alias("n_query"))
