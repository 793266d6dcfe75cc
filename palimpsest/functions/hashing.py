"""Content hashes, canonical JSON and identifiers as column expressions."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_KEY = re.compile(r"^[a-f0-9]{16}$")


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return text


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with keys sorted at every level and no blanks; text that isn't JSON stays as it is."""
    return text.map(_canonical, na_action="ignore")


def content_hash(title: Column, kind: Column, external_ref: Column, attributes: Column, chunk_texts: Column) -> Column:
    """SHA-256 over title, kind, reference, canonical attributes and chunk texts; a null counts as empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws(" ", part(title), part(kind), part(external_ref), part(attributes), part(F.array_join(chunk_texts, ""))), 256)


def source_hash(adapter: Column, occurred_at: Column, document_json: Column) -> Column:
    """Identity of a raw capture: SHA-256 over its canonical JSON (keys in order: adapter, document, occurredAt)."""
    q = lambda c: F.get(F.split(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), '"v":'), F.lit(1))
    inner = lambda c: F.regexp_replace(q(c), r"\}$", "")
    return F.sha2(F.concat(F.lit('{"adapter":'), inner(adapter), F.lit(',"document":'), F.coalesce(document_json, F.lit("null")), F.lit(',"occurredAt":'), inner(occurred_at), F.lit("}")), 256)


def record_id(prefix: str, *key: Column) -> Column:
    """A stable identifier: the same key gives the same id, so work done twice writes the same rows."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]), 256), 1, 22))


def model_key(base_url: str, model_id: str) -> str:
    """Key of an embedding model and the endpoint that serves it."""
    return hashlib.sha256(f"{base_url}|{model_id}".encode()).hexdigest()[:16]


def model_key_column(base_url: Column, model_id: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", base_url, model_id), 256), 1, 16)


def embedding_table(key: str) -> str:
    """Name of a model's partition; refuses anything that isn't a model key."""
    if not MODEL_KEY.fullmatch(key):
        raise ValueError(f"not a model key: {key!r}")
    return f"embedding_{key}"
