"""The few functions without a builtin: canonical JSON, NFKC, keyed digests, spans of findings, scrubbing, licences."""

from __future__ import annotations

import hashlib
import hmac
import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from .text import DETECTORS


def canonical_json(value) -> str:
    """JSON with sorted keys (by UTF-16 code units), no spaces; whole floats print as integers."""
    if isinstance(value, float) and value == int(value) and abs(value) < 1e21:
        value = int(value)
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)



def canonical(text: str) -> str | None:
    return _of_json(lambda value: canonical_json(value))(text)


def _of_json(f):
    """``f`` of a JSON text's value; null for what isn't JSON, or holds numbers that overflow or levels beyond the stack."""

    def run(text: str):
        try:
            return f(json.loads(text))
        except (ValueError, OverflowError, RecursionError):
            return None

    return run


def keyed_group(secret: str, domain: str, alias: str) -> str:
    return hmac.new(secret.encode(), f"{domain}\0{unicodedata.normalize('NFKC', alias.strip())}".encode(), hashlib.sha256).hexdigest()


_OPAQUE = {"thoughtSignature", "thought_signature", "encrypted_content", "encryptedContent"}


def scrub(value, depth: int = 0) -> tuple[object, int]:
    """Without encrypted reasoning fields, and the number removed; beyond 64 levels null."""
    if depth > 64:
        return None, 0
    if isinstance(value, list):
        made = [scrub(x, depth + 1) for x in value]
        return [x for x, _ in made], sum(n for _, n in made)
    if not isinstance(value, dict):
        return value, 0
    out, removed, kind = {}, 0, value.get("type")
    for k, x in value.items():
        hidden = k in _OPAQUE or (k == "signature" and kind in ("thinking", "signature_delta")) or (k == "data" and kind == "redacted_thinking")
        if hidden:
            removed += isinstance(x, str) and bool(x)
        else:
            out[k], n = scrub(x, depth + 1)
            removed += n
    return out, removed


_PYTHON = {k: [re.compile(p, re.ASCII) for p in patterns] for k, (_, patterns) in DETECTORS.items()}


def spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, severity)`` by start, longer first; dates and long digit runs are no phones."""
    out = []
    for kind, patterns in _PYTHON.items():
        for p in patterns:
            for m in p.finditer(text):
                s = m.group()
                if kind == "phone" and (re.match(r"\d{4}-\d{2}-\d{2}", s) or len(re.sub(r"\D", "", s)) > 15):
                    continue
                out.append((kind, m.start(), m.end(), DETECTORS[kind][0]))
    return sorted(out, key=lambda f: (f[1], -f[2]))


def redact(text: str, form: str = "[REDACTED:{}]") -> str:
    """Findings replaced from right to left; overlapping ones aren't merged."""
    for kind, a, b, _ in sorted(spans(text), key=lambda f: f[1], reverse=True):
        text = text[:a] + form.format(kind.upper()) + text[b:]
    return text


_SENSITIVE = re.compile(r"(?:^|_)(?:password|passwd|secret|token|api_key|authorization|cookie|credential|private_key)(?:_|$)")
_DIGEST = re.compile(r"^[0-9a-f]{64}$")


def redact_structured(value, path: str = "") -> object:
    """Strings of a JSON value redacted; values of sensitive keys replaced whole; digests under ``*sha256`` keys kept."""
    leaf = re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", path.rpartition(".")[2])).lower()
    if isinstance(value, dict):
        return {k: redact_structured(v, f"{path}.{k}" if path else k) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_structured(v, path) for v in value]
    if isinstance(value, str):
        if leaf.endswith("sha256") and _DIGEST.match(value):
            return value
        return "[REDACTED:SENSITIVE_KEY]" if _SENSITIVE.search(leaf) else redact(value)
    return value


_SPDX = re.compile(r"\s*(\(|\)|AND\b|OR\b|WITH\b|[A-Za-z0-9.+:-]+)")


def is_spdx(text: str) -> bool:
    """A licence expression: ids with an optional ``WITH`` exception, ``AND``, ``OR`` and parentheses."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _SPDX.match(text, at)
        if not m:
            return False
        tokens.append(m[1])
        at = m.end()
    words = {"(", ")", "AND", "OR", "WITH"}

    def operand(i: int) -> int:
        if i < len(tokens) and tokens[i] == "(":
            i = expression(i + 1)
            return i + 1 if 0 <= i < len(tokens) and tokens[i] == ")" else -1
        if i >= len(tokens) or tokens[i] in words:
            return -1
        if i + 1 < len(tokens) and tokens[i + 1] == "WITH":
            return i + 3 if i + 2 < len(tokens) and tokens[i + 2] not in words else -1
        return i + 1

    def expression(i: int) -> int:
        i = operand(i)
        while 0 <= i < len(tokens) and tokens[i] in ("AND", "OR"):
            i = operand(i + 1)
        return i

    return bool(tokens) and expression(0) == len(tokens)


# Arrow batches, made when a session exists.
def canonical_json_udf():
    return F.pandas_udf(_typed(canonical), "string")


def nfkc_udf():
    return F.pandas_udf(_typed(lambda x: unicodedata.normalize("NFKC", x)), "string")


def redact_udf():
    return F.pandas_udf(_typed(redact), "string")


def redact_structured_udf():
    return F.pandas_udf(_typed(_of_json(lambda value: canonical_json(redact_structured(value)))), "string")


def entities_udf():
    return F.pandas_udf(_typed(html.unescape), "string")


def scrub_udf():
    return F.pandas_udf(_typed(_of_json(lambda value: canonical_json(scrub(value)[0]))), "string")


def keyed_group_udf(secret: str, domain: str):
    return F.pandas_udf(_typed(lambda x: keyed_group(secret, domain, x)), "string")


def spdx_udf():
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else is_spdx(x))

    return run


def _typed(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run
