"""Splitting oversized texts at natural boundaries by packing their structure tree.

A text is read as a tree: sections under headings, blocks between blank lines, list items and lines, sentences, words.
A node within the limit stays whole; only an oversized node is opened. Whole siblings are merged, bottom-up, as far as
the limit allows; what an opened node was cut into is not merged with its siblings, so a piece holds a heading inside
only if it holds whole sections. Only a stretch without any boundary that alone exceeds the limit is cut by force.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points a piece may have, and how many of the piece before it may start with.
LIMIT, OVERLAP = 2_800, 240
LEVELS = ("section", "block", "item", "line", "sentence", "word", "blank", "forced")
_HEADING = re.compile(r"^(#{1,6})[ \t]", re.M)
_CUT_AFTER = {
    "block": re.compile(r"\n[^\S\n]*\n\s*"),
    "line": re.compile(r"\n"),
    "sentence": re.compile(r"[.!?…]+[\"'”»)\]]*\s+|[。！？]\s*"),
    "word": re.compile(r"[\s。]+"),
}
_ITEM = re.compile(r"^[ \t]*(?:[-*+•]|\d+[.)])[ \t]", re.M)
_BLANK = re.compile(r"[\s。]")


def _spans(cuts: list[int], s: int, e: int) -> list[tuple[int, int]]:
    points = [s, *sorted({c for c in cuts if s < c < e}), e]
    return list(zip(points[:-1], points[1:], strict=True))


def children(text: str, level: str, s: int, e: int) -> list[tuple[int, int]]:
    """Spans of the parts of text[s:e] at one level of structure; they cover it without gaps."""
    if level == "section":
        marks = [(m.start(), len(m[1])) for m in _HEADING.finditer(text, s, e) if m.start() > s]
        top = min((d for _, d in marks), default=0)
        return _spans([p for p, d in marks if d == top], s, e)
    if level == "item":
        return _spans([m.start() for m in _ITEM.finditer(text, s, e)], s, e)
    if level == "blank":
        return _spans([p for m in _BLANK.finditer(text, s, e) for p in (m.start(), m.end())], s, e)
    return _spans([m.end() for m in _CUT_AFTER[level].finditer(text, s, e)], s, e)


def pack(text: str, s: int, e: int, limit: int, room: int, depth: int = 0) -> list[tuple[int, int, str]]:
    """Adjacent spans (start, end, level of the cut at its end) of at most `room`, or of at most `limit` where a single
    unbreakable stretch needs it."""
    if e - s <= room:
        return [(s, e, "")]
    level = LEVELS[depth]
    if level == "forced":
        if e - s <= limit:
            return [(s, e, "")]
        return [(p, min(p + room, e), "forced") for p in range(s, e, room)]
    parts = children(text, level, s, e)
    if len(parts) == 1:
        return pack(text, s, e, limit, room, depth + 1)
    again = level == "section"  # headings of deeper levels are found by reading the section once more
    out: list[tuple[int, int, str]] = []
    whole_before = False
    for a, b in parts:
        whole = b - a <= room
        if whole and whole_before and b - out[-1][0] <= room:
            out[-1] = (out[-1][0], b, level)
        else:
            out += pack(text, a, b, limit, room, depth if again else depth + 1)
            out[-1] = (*out[-1][:2], level)
        whole_before = whole
    return out


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start of the piece with its overlap, start of its own text, end, cut at its end) of each piece.

    The pieces' own texts are the text, in order and whole. A piece has at most `limit` code points with its overlap,
    which starts at a boundary if there is one in reach. A text within the limit is one piece; an empty one none.
    The cut is the level of structure at the end, `end` for the last.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text), "end")]
    own = pack(text, 0, len(text), limit, max(1, limit - overlap))
    out = []
    for k, (s, e, cut) in enumerate(own):
        start = s
        if k and overlap:
            reach = max(own[k - 1][0], s - min(overlap, limit - (e - s)))
            at = next((m.end() for m in _BLANK.finditer(text, max(0, reach - 1), s) if m.end() < s), reach)
            start = at if at < s else s
        out.append((start, s, e, cut if k + 1 < len(own) else "end"))
    return out


def split_texts(df: DataFrame, id_col: str = "id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text of more than `limit` code points: id, ordinal (from 0), start, own_start, end, cut, text.

    A null or empty text, or one within the limit, gives no rows. Rows delivered twice give their pieces twice. Only
    oversized rows leave the JVM; each is split on its own, so nothing is shuffled.
    """
    big = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.length("text") > limit)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            pieces = [(row, n, *p, t[p[0] : p[2]]) for row, t in enumerate(texts) for n, p in enumerate(split(t, limit, overlap))]
            row, *columns = zip(*pieces, strict=True) if pieces else [()] * 7
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "ordinal", "start", "own_start", "end", "cut", "text"],
            )

    kind = big.schema["id"].dataType.simpleString()
    return big.mapInArrow(run, f"id {kind}, ordinal int, start int, own_start int, end int, cut string, text string")
