"""The corpus pipeline from end to end against brute force, on a small table with awkward rows."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spoorlake.llm import quality, secret_scan, sharding

from .test_documents import brute_fingerprint

TOKEN = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
DDL = "doc_id long, text string, lang string, source string, n_chars long, fp long, row long, doc string, ratio double, host string, salt int, part long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(2)
    words = "the of road people weather quiet river and house garden evening light over under market stone bread water".split()
    prose = lambda n: "The " + " ".join(r.choice(words) for _ in range(n)) + "."
    texts = [prose(60 + i) for i in range(80)]
    texts += [texts[0], texts[1], texts[1], None, "", "  ", f'set token = "{TOKEN}" for ' + prose(50), "BUY NOW!!! $$$ " * 40, prose(6000)]
    texts += ["*** ### !!! " * (i + 5) for i in range(40)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", None if t is None else len(t), *[i] * 2, "own", 0.5, "h", i, i) for i, t in enumerate(texts)] + [(None, prose(40), "en", "s1", 1, 0, 0, "own", 0.0, "h", 0, 0)]
    rows.append(rows[2])  # a repeated row
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DDL).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i < 89 and i != 87), 0) for i in range(129) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def key(rows):
    return sorted(map(str, map(tuple, rows)))


def test_every_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, sf)
    assert good.columns == docs.columns
    judged = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    kept = collections.Counter(r.doc_id for r in judged if r.keep)
    assert collections.Counter(r.doc_id for r in good.collect()) == kept
    assert {*range(80)} <= set(kept) and not {*range(89, 129)} & set(kept)

    good = good.checkpoint()
    one = stages["near_duplicates"](spark, good, sf)
    rows = [tuple(r) for r in good.collect()]
    fps = [brute_fingerprint(r[1] or "") for r in rows]
    part = [*range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    best = {}
    for r, p in zip(rows, part):
        best[p] = min(best.get(p, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert one.columns == docs.columns and key(one.collect()) == key(best.values())

    one = one.checkpoint()
    safe = stages["secret_scan"](spark, one, sf)
    before, after = {r.doc_id: r for r in one.collect()}, {r.doc_id: r for r in safe.collect()}
    assert safe.columns == docs.columns and before.keys() == after.keys()
    changed = {d for d in before if before[d].text != after[d].text}
    assert changed == {d for d, r in before.items() if TOKEN in (r.text or "")} and all(secret_scan.MARK in after[d].text and TOKEN not in after[d].text and after[d].n_chars == len(after[d].text) for d in changed)
    assert all(after[d][5:] == before[d][5:] for d in before)

    packed = stages["best_fit_packing"](spark, safe, sf).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = collections.Counter()
    for d, r in after.items():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), 4096):
            want[d, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in packed) == want
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096
    assert key(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect()) == key(tuple(r)[:5] for r in packed)


def test_an_empty_table_passes_all_stages(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_propagation_cuts_fewer_links_than_chance(spark):
    rows = spark.createDataFrame([(i, f"t{i // 6}") for i in range(2400)], "doc_id long, text string")
    got = sharding.shard_documents(rows).collect()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.text_crc32].append(r.shard)
    pairs = lambda n: n * (n - 1) / 2
    inside = sum(pairs(n) for shards in groups.values() for n in collections.Counter(shards).values())
    assert inside > 0.9 * sum(pairs(len(s)) for s in groups.values())  # by chance: one in 24
    assert set(collections.Counter(r.shard for r in got).values()) == {100}
