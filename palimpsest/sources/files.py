"""Ingest of files through a pluggable text extractor."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Extractor = Callable[[bytes, str | None, str | None], tuple[str | None, str]]


def html_extractor(content: bytes, mime: str | None = None, filename: str | None = None) -> tuple[str | None, str]:
    """(title, text) of a page: tags, scripts and styles removed."""
    t = content.decode("utf-8", "replace")
    title = re.search(r"<title[^>]*>(.*?)</title>", t, re.S | re.I)
    body = re.sub(r"<(script|style|title)\b.*?</\1>|<[^>]+>", " ", t, flags=re.S | re.I)
    return (title[1].strip() or None) if title else None, re.sub(r"\s+", " ", body).strip()


def extracted(files: DataFrame, extract: Extractor) -> DataFrame:
    """(path, title, text, error) of rows of the binary-file source. A title comes from the extractor, else from the file's
    name; a file on which it fails has a null text and its error."""

    def run(batches):
        for b in batches:
            titles, texts, errors = [], [], []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    title, text = extract(content or b"", None, name)
                    error = None
                except Exception as e:
                    title, text, error = None, None, f"{type(e).__name__}: {e}"
                titles.append(title)
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column("path"), *(pa.array(x, pa.string()) for x in (titles, texts, errors))], names=["path", "title", "text", "error"])

    out = files.select("path", "content").mapInArrow(run, "path string, title string, text string, error string")
    name = F.element_at(F.split("path", "/"), -1)
    return out.withColumn("title", F.coalesce("title", F.when(name != "", name), F.lit("untitled")))


def read_files(spark: SparkSession, path: str, extract: Extractor = html_extractor) -> DataFrame:
    """The files under a path, extracted. Files without any byte are not read."""
    return extracted(spark.read.format("binaryFile").load(path), extract)


def one_of(content: str | None, file: dict | None) -> None:
    """A request holds a content or a file, not both and not neither."""
    if (content is None) == (file is None):
        raise ValueError("exactly one of content and file is needed")
