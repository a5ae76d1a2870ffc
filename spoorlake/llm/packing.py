"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Pieces longer than a third of the capacity share a sequence with at most one other such piece: from the longest down,
each is matched greedily with the longest partner that fits. Shorter pieces then go, longest first, into the tightest
gap that holds them, or open new sequences. Both steps work on the histogram of piece lengths (at most ``capacity``
entries, whatever the corpus), so the driver plans runs of equal sequences, and Spark gives every piece its place by
its rank among the pieces of its length. Ranks come from counts of (length, bucket): no window over a whole length.

Defined results: null or empty text is a document of one id (the end id); documents longer than the capacity are cut
into full pieces; repeated rows are packed as often as they occur; a null ``doc_id`` is packed and stays null.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, partition_id, release, texts_of, written

CAPACITY = 4096
END_ID = 1
#: Chunks whose ids a task remembers (about 200 bytes each); they are forgotten at its end, as workers live on.
CACHE = 400_000

#: A chunk of Latin letters and the punctuation after it, or any other chunk; one a line.
_CHUNK = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)|(.*))$", re.M)


class _Known(dict):
    """Codes of chunks; a new chunk gets the next code and waits to be encoded."""

    def __init__(self):
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file whose pre-tokens never span ASCII white space. Text is cut there
    and the chunks' ids are remembered; words of Latin letters that aren't known are encoded many in one call, by the
    same model without the normaliser and the expressions that such words, in lower case, pass unchanged."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain.encode_special_tokens = True
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.last[ends] = True
        self.limit = cache
        self.forget()

    def _one(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Of words of letters in lower case, and of runs of punctuation."""
        out = {}
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        made = self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, made):
            ids = np.array(encoding.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
                out.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                out.update((w, self._one(w)) for w in group)
        return out

    def _learn(self) -> None:
        """Encode the chunks that wait."""
        new, self.codes.new = self.codes.new, []
        if not new:
            return
        parts = [(w.lower(), marks, other) for w, marks, other in _CHUNK.findall("\n".join(new))]
        known, words = self.words, {x for w, marks, other in parts for x in (w, marks)}
        fresh = [w for w in words if w not in known]
        if fresh:
            known.update(self._words(fresh))
        self.table += [self._one(other) if other else known[w] + known[marks] for w, marks, other in parts]

    def forget(self) -> None:
        self.codes, self.table, self.words = _Known(), [b""], {"": b""}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            size, end = 0, start
            while end < len(texts) and (size < 2_000_000 or end == start):
                size += len(texts[end])
                end += 1
            if len(self.codes) > self.limit:
                self.forget()
            code = self.codes.__getitem__
            coded = [[*map(code, re.sub("[\n\t\r]", " ", t).split(" "))] for t in texts[start:end]]
            self._learn()
            of = self.table.__getitem__
            out += [b"".join(map(of, codes)) for codes in coded]
            start = end
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str, cache: int = CACHE) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    _tokenizers[path].limit = cache
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document, plus ``task`` and ``n``, which
    together number the rows of this run."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "n"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    schema = pa.schema([*zip(names, kinds)])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, n = tokenizer(path, cache), partition_id(), 0
        for b, texts in texts_of(batches):
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), words.ids(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), task, n, part)[: len(names)])
                    n += 1
            yield batch(schema, [*zip(*rows)])
        words.forget()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, n long" + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first_rank, n_sequences, per_sequence, sequence, offset)``: the pieces of that length with
    ranks from first_rank on lie, per_sequence after each other, in the n_sequences from ``sequence`` on, at ``offset``."""
    left = {n: c for n, c in histogram.items() if c}
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted gaps with sequences
    of_gap: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, number)
    opened = 0

    def place(length: int, count: int, each: int, sequence: int, used: int) -> None:
        runs.append((length, taken[length], count, each, sequence, used))
        taken[length] += count * each
        left[length] -= count * each

    def add_gap(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if not of_gap[gap]:
                insort(gaps, gap)
            of_gap[gap].append((sequence, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:  # at most two steps a length; lengths that are used up are skipped
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_left(large, capacity - a + 1) - 1
        while at >= 0 and (not left[large[at]] or (large[at] == a and left[a] == 1)):
            at -= 1
        b = large[at] if at >= 0 else None
        if b is None:
            count = left[a]
            place(a, count, 1, opened, 0)
            add_gap(capacity - a, opened, count)
        elif b == a:
            count = left[a] // 2
            place(a, count, 2, opened, 0)
            add_gap(capacity - 2 * a, opened, count)
        else:
            count = min(left[a], left[b])
            place(a, count, 1, opened, 0)
            place(b, count, 1, opened, a)
            add_gap(capacity - a - b, opened, count)
        opened += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = min(capacity // n, left[n])
                count = left[n] // each
                place(n, count, each, opened, 0)
                add_gap(capacity - each * n, opened, count)
                opened += count
                continue
            gap = gaps[at]
            sequence, there = of_gap[gap].pop()
            if not of_gap[gap]:
                gaps.pop(at)
            each = min(gap // n, left[n])
            count = min(there, left[n] // each)
            place(n, count, each, sequence, capacity - gap)
            add_gap(gap - each * n, sequence, count)
            add_gap(gap, sequence + count, there - count)
    return runs


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of :func:`pieces`; drops ``task`` and ``n``."""
    spark = rows.sparkSession
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    if not runs:
        return rows.drop("task", "n").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # Ranks within a length: bucket by task (bounded by what one task read), counts give each bucket its first rank.
    inner = Window.partitionBy("length", "task").orderBy("n")
    firsts = rows.groupBy("length", "task").count().withColumn(
        "first", F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    )
    firsts = written(firsts.select("length", "task", F.coalesce("first", F.lit(0)).alias("first")), "firsts")
    ranked = rows.withColumn("r", F.row_number().over(inner) - 1).join(firsts, ["length", "task"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("r"))
    # The run of a rank: runs of a length are consecutive in rank, so a range of ranks finds its run by array search.
    of_length: dict[int, list] = defaultdict(list)
    for run in runs:
        of_length[run[0]].append(run[1:])
    table = [(n, sorted(x)) for n, x in of_length.items()]
    kind = "length long, runs array<struct<first_rank: long, n: long, each: long, sequence: long, at: long>>"
    planned = F.broadcast(spark.createDataFrame(table, kind))  # at most `capacity` rows, whatever the corpus
    found = F.element_at(F.filter("runs", lambda x: x["first_rank"] <= F.col("rank")), -1)
    placed = ranked.join(planned, "length").withColumn("run", found).withColumn("k", F.col("rank") - F.col("run.first_rank"))
    return placed.withColumns({
        "sequence_id": F.col("run.sequence") + F.floor(F.col("k") / F.col("run.each")),
        "offset": F.col("run.at") + F.pmod("k", F.col("run.each")) * F.col("length"),
    }).drop("task", "n", "r", "first", "rank", "runs", "run", "k")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Tokenise, cut and pack all ``docs``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and
    ``ids``). The pieces are written once; only their lengths are shuffled unless ``with_ids``."""
    rows = written(pieces(docs, path, capacity, end_id, with_ids, cache), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return pack(rows, capacity).select(*columns)
