"""Byte-level BPE encoding and decoding with a sentencepiece model that is serialised directly from a rank file.

Each byte becomes one printable character (as public byte-level vocabularies do), each vocabulary entry a piece scored
by its negative rank, the normaliser is the identity. Sentencepiece then merges the adjacent pair whose concatenation
has the best score, leftmost first, which is the order of the ranks. Pre-tokens (matches of ``pattern``) are encoded
one by one; decoding maps ids back to bytes.

Defined results: null or empty text has no ids (``ids_sha256`` of the empty string); any Unicode text round-trips;
repeated rows give repeated rows; other columns of the input are ignored; a null id stays null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch, texts_of

#: Chunks whose ids each Python worker remembers (about 200 bytes each).
CACHE = 400_000


def byte_chars() -> list[str]:
    """A distinct printable, non-space character for each byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto (wire format) whose piece ids are the ranks; the id after the last is <unk>."""
    chars = byte_chars()
    by_id = {r: t for t, r in ranks.items()}
    if sorted(by_id) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1 without gaps")
    out = bytearray()
    for r in range(len(ranks)):
        piece = "".join(chars[b] for b in by_id[r]).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(r)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    absent = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks))
    trainer += b"".join(_field(n, absent) for n in (41, 42, 43))
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.chars = byte_chars()
        self.mapped = str.maketrans({chr(i): c for i, c in enumerate(self.chars)})
        self.bytes_of = {str(r): t for t, r in ranks.items()}
        self.cache: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        self.limit = cache
        self.gap = re.compile(r"\s\s")

    def _learn(self, chunks: set[str]) -> None:
        """Fill the cache for chunks that aren't in it: all their new pre-tokens in one call."""
        cut = {c: self.pattern.findall(c) for c in chunks}
        tokens = self.tokens
        new = [*{t for pieces in cut.values() for t in pieces if t not in tokens}]
        raw = [t.encode("utf-8", "surrogatepass") for t in new]
        whole = [self.ranks.get(r) for r in raw]
        rare = [i for i, w in enumerate(whole) if w is None]
        ids = self.model.encode([raw[i].decode("latin-1").translate(self.mapped) for i in rare], num_threads=1) if rare else []
        made = [str(w) for w in whole]
        for i, x in zip(rare, ids):
            made[i] = " ".join(map(str, x))
        if len(self.tokens) + len(new) > self.limit:
            known = {t: self.tokens[t] for pieces in cut.values() for t in pieces if t in self.tokens}
            self.tokens = known
        self.tokens.update(zip(new, made))
        of = self.tokens.__getitem__
        self.cache.update((c, " ".join(map(of, pieces))) for c, pieces in cut.items())

    def _chunks(self, text: str) -> list[str]:
        """A space between two characters that aren't white space always starts a pre-token, so there the text is cut
        into chunks that recur; other texts are cut by the pattern itself."""
        if self.gap.search(text):
            return self.pattern.findall(text)
        head, *rest = text.split(" ")
        return [head, *[" " + w for w in rest]] if head else [" " + w for w in rest]

    def encode(self, text: str) -> str:
        """Decimal ids joined by spaces."""
        if not text:
            return ""
        chunks = self._chunks(text)
        cache = self.cache
        new = {c for c in chunks if c not in cache}
        if new:
            if len(self.cache) + len(new) > self.limit:
                self.cache.clear()
                new = set(chunks)
            self._learn(new)
        return " ".join(map(self.cache.__getitem__, chunks))

    def encode_all(self, texts: list[str]) -> list[str]:
        """Ids of each text; what a block of texts has that is new is encoded together."""
        out: list[str] = []
        start = 0
        while start < len(texts):
            size, end = 0, start
            while end < len(texts) and (size < 2_000_000 or end == start):
                size += len(texts[end])
                end += 1
            cut = [self._chunks(t) if t else [] for t in texts[start:end]]
            wanted = {c for chunks in cut for c in chunks}
            cache = self.cache
            new = {c for c in wanted if c not in cache}
            if new:
                if len(self.cache) + len(new) > self.limit:
                    self.cache.clear()
                    new = wanted
                self._learn(new)
            of = self.cache.__getitem__
            out += [" ".join(map(of, chunks)) for chunks in cut]
            start = end
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


_coders: dict[tuple, ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder a Python process."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, emit: Callable | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (binary) of every text. ``path`` must be readable on each
    executor. A map over the rows: no shuffle, memory bounded by one text and the cache."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b, texts in texts_of(batches):
            ids = bpe.encode_all(texts)
            yield batch(schema, [b.column("doc_id"), [[*map(int, x.split())] for x in ids], [bpe.decode(x) for x in ids]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digests of :func:`encode_documents` made where the ids are: they don't travel to the JVM."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b, texts in texts_of(batches):
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_all(texts):
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield batch(schema, [b.column("doc_id"), n, ids_sha, text_sha])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
