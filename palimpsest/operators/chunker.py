"""Chunks of bounded size with overlap, by a ladder of separators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default bounds in approximate tokens, characters per token, and separators from coarse to fine (fixed values).
MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 700, 40, 60, 4
LADDER = ("\n\n", "\n", ". ", " ")
CHUNK = "array<struct<ordinal:int,text:string,token_count:int,start:int,end:int>>"


def approx_tokens(chars: Column) -> Column:
    """At least 1, else a quarter of the characters, rounded up."""
    return F.greatest(F.lit(1), F.ceil(chars / CHARS_PER_TOKEN).cast("int"))


def _leaves(text: str, start: int, most: int, step: int = 0) -> list[tuple[int, int]]:
    """Spans of at most `most` characters: parts keep the separator they end with; a part too long goes down the ladder,
    and below it is cut hard."""
    if len(text) <= most:
        return [(start, start + len(text))] if text else []
    if step == len(LADDER):
        return [(start + i, start + min(i + most, len(text))) for i in range(0, len(text), most)]
    out, at, sep = [], 0, LADDER[step]
    while at < len(text):
        hit = text.find(sep, at)
        end = len(text) if hit < 0 else hit + len(sep)
        out += _leaves(text[at:end], start + at, most, step + 1)
        at = end
    return out


def chunk_groups(text: str, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> list[list[tuple[int, int]]]:
    """The leaves (spans) of each chunk of a text.

    Leaves are gathered until the next would not fit; the next chunk begins with as many whole leaves from the end of the
    last as the overlap holds, and takes the new leaf in any case, so it may be longer than the most by the overlap. A
    last chunk under the least size joins the one before, with the leaves that it shares with it.
    """
    most, least, overlap = max_tokens * CHARS_PER_TOKEN, min_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN
    groups: list[list[tuple[int, int]]] = []
    group: list[tuple[int, int]] = []
    for leaf in _leaves(text, 0, most):
        if group and leaf[1] - group[0][0] > most:
            groups.append(group)
            group = [x for x in group if group[-1][1] - x[0] <= overlap]
        group = [*group, leaf]
    if group:
        groups.append(group)
    if len(groups) > 1 and groups[-1][-1][1] - groups[-1][0][0] < least:
        last = groups.pop()
        groups[-1] = groups[-1] + last
    return groups


def chunk_texts(text: str, *bounds: int) -> list[tuple[int, int, str]]:
    """(start, end, text) of each chunk; the text is that of its leaves, one after another."""
    return [(g[0][0], g[-1][1], "".join(text[a:b] for a, b in g)) for g in chunk_groups(text, *bounds)]


def chunk_udf(max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, overlap_tokens: int = OVERLAP_TOKENS):
    """A column function text -> array of chunks; a null or empty text has none."""

    @F.pandas_udf(CHUNK)
    def chunks(text: pd.Series) -> pd.Series:
        def of(t):
            made = chunk_texts(t or "", max_tokens, min_tokens, overlap_tokens)
            return [{"ordinal": i, "text": c, "token_count": max(1, -(-len(c) // CHARS_PER_TOKEN)), "start": a, "end": b} for i, (a, b, c) in enumerate(made)]

        return pd.Series([of(t) for t in text])

    return chunks


def rechunk(parts: DataFrame, key: str = "document_id", chunks=None) -> DataFrame:
    """Chunks of the parts of each document, numbered through: key, ordinal, text, token_count, role, start, end.

    parts: key, ordinal, text, role. Roles are inherited; spans start again with each part.
    """
    made = parts.select(key, F.col("ordinal").alias("part"), "role", F.inline((chunks or chunk_udf())(F.col("text"))))
    order = Window.partitionBy(key).orderBy("part", "ordinal")
    return made.withColumn("ordinal", F.row_number().over(order) - 1).select(key, "ordinal", "text", "token_count", "role", "start", "end")
