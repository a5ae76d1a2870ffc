"""ZIP sources: bounded inspection, then the entries as rows."""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

LIMITS = {"entries": 10_000, "entry_bytes": 64 << 20, "total_bytes": 256 << 20}


def inspect(data: bytes, limits: dict[str, int] = LIMITS) -> tuple[list[zipfile.ZipInfo], str | None]:
    """The entries, or the reason why the archive is refused: damage, too much, encryption, unusual methods, paths that
    leave the folder, control characters, links, or names that collide after normalisation."""
    try:
        infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        return [], "damaged"
    if len(infos) > limits["entries"]:
        return [], "too_many_entries"
    seen: set[str] = set()
    total = 0
    for i in infos:
        name = i.filename
        total += i.file_size
        if i.flag_bits & 1:
            return [], "encrypted"
        if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            return [], "method"
        if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or ":" in name[:3]:
            return [], "traversal"
        if any(unicodedata.category(c) == "Cc" for c in name):
            return [], "control_character"
        if (i.external_attr >> 16) & 0o170000 == 0o120000:
            return [], "symlink"
        folded = unicodedata.normalize("NFC", name).lower()
        if folded in seen:
            return [], "name_collision"
        seen.add(folded)
        if i.file_size > limits["entry_bytes"]:
            return [], "entry_too_large"
        if total > limits["total_bytes"]:
            return [], "archive_too_large"
    return infos, None


def zip_entries(spark: SparkSession, path: str, limits: dict[str, int] = LIMITS) -> DataFrame:
    """``path, entry, content, rejected`` of the ZIP files under ``path``: text entries, or one row with the reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for where, data in zip(frame["path"], frame["content"]):
                infos, reason = inspect(bytes(data), limits)
                if reason:
                    rows.append((where, None, None, reason))
                    continue
                z = zipfile.ZipFile(io.BytesIO(bytes(data)))
                for i in sorted(infos, key=lambda i: i.filename):
                    if not i.is_dir():
                        try:
                            rows.append((where, i.filename, z.read(i).decode("utf-8"), None))
                        except (UnicodeDecodeError, zipfile.BadZipFile) as e:
                            rows.append((where, i.filename, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "entry", "content", "rejected"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, entry string, content string, rejected string")
