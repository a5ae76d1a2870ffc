"""Near duplicates and contamination of texts that aren't NFKC, against brute force over normalised texts."""

import random
import re
import unicodedata

import __spark_entry__ as entry
from spoorlake.plans import dedupe

PROSE = "the café in Zürich serves a naïve résumé of fine flûte music for every guest who signs the office file"
FORMS = [PROSE, unicodedata.normalize("NFD", PROSE), PROSE.replace("fi", "ﬁ"), "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in PROSE), "quite another text about ships and harbours"]


def words(text):
    return re.findall(r"\w+", unicodedata.normalize("NFKC", text).lower())


def grams(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_texts_in_other_unicode_forms_are_near_duplicates(spark, tmp_path):
    sf = str(tmp_path)
    docs = list(enumerate(FORMS))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(7, FORMS[1])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([("c", i, "user", t) for i, t in docs], "conv_id string, turn int, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    run = lambda name, *columns: [tuple(r) for r in entry.queries()[name](spark, sf).select(*columns).collect()]

    jaccard = lambda a, b: len(grams(a, 3) & grams(b, 3)) / len(grams(a, 3) | grams(b, 3))
    near = {(i, j) for i, a in docs for j, b in docs if i < j and jaccard(a, b) >= 0.8}
    assert len(near) == 6 and set(run("near_dup_pairs", "a", "b")) == near
    assert set(run("near_dup_classes", "id", "n_features")) == {(i, len(grams(t, 3))) for i, t in docs}
    shared = {(7, i, len(grams(t, 8) & grams(FORMS[1], 8)), len(grams(FORMS[1], 8))) for i, t in docs if grams(t, 8) & grams(FORMS[1], 8)}
    assert len(shared) == 4 and set(run("benchmark_contamination", "item_id", "doc_id", "shared", "n_item")) == shared
    assert set(run("text_near_dup_in_group", "a", "b")) == near


def test_no_python_worker_holds_texts(spark):
    for name in ("near_dup_limits", "benchmark_contamination", "near_dup_classes", "near_dup_pairs", "text_near_dup_in_group", "text_near_dup_edited"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_limits_of_no_and_of_wordless_texts(spark, tmp_path):
    for n, texts in enumerate(([], [None, ""], ["", "?!", "a b c d", "a b c d", "b c d"])):
        sf = f"{tmp_path}/{n}"
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
        (got,) = entry.queries()["near_dup_limits"](spark, sf).collect()
        assert (got.records, got.features, got.most_features, got.most_postings, got.reason_code) == ((3, 4, 2, 2, None) if n == 2 else (0, 0, 0, 0, None))


def test_turns_about_the_limit_and_the_turns_that_are_moved(spark):
    """A turn and edits of it, on both sides of 0.82, in several conversations; only first shingles are joined."""
    r = random.Random(5)
    bases = [[r.choice("abcdefgh") * 2 + str(r.randrange(40)) for _ in range(n)] for n in (12, 40, 90)]
    texts = []
    for i in range(120):
        w = list(bases[i % 3])
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"new{r.randrange(6)}"
        texts.append((i % 2, i, r.choice([" ", "  "]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    triples = lambda t: {tuple(t.lower().split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    norm = {i: " ".join(t.lower().split()) for _, i, t in texts}
    want = set()
    for c, i, t in texts:
        for d, j, u in texts:
            x, y = triples(t), triples(u)
            long = min(len(norm[i]), len(norm[j])) >= 0.8 * max(len(norm[i]), len(norm[j]))
            if c == d and i < j and t != u and (norm[i] == norm[j] or long and len(x & y) >= 0.82 * len(x | y)):
                want.add((c, i, j))
    got = dedupe.near_in_group(spark.createDataFrame(texts, "conv_id long, turn long, text string"))
    assert len(want) > 100 and {tuple(x) for x in got.collect()} == want
    joined = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in joined  # the written pairs are joined with whole sets, shingles aren't
