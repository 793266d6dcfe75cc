"""Text expressions: tokens, lexical rank, snippets, and an English mode with stop words and stems."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNIPPET = 240
#: Weight of a word of body text, and the limit of the sum of inverse squares (fixed values of the ranking function).
WEIGHT, ZETA_2 = 0.1, 1.64493406685
#: English stop words of the usual list for full-text search (fixed values).
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
    them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now""".split()
)


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def snippet(c: Column, size: int = SNIPPET) -> Column:
    """Trimmed text, or its first `size` characters and an ellipsis."""
    t = trimmed(c)
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.substring(t, 1, size), F.lit("…")))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null for null."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def single_rank(positions: Column) -> Column:
    """Rank of one lexeme by its number of occurrences: the j-th adds 0.1 / j^2."""
    return F.aggregate(F.sequence(F.lit(1), F.size(positions)), F.lit(0.0), lambda a, j: a + WEIGHT / (j * j)) / ZETA_2


def nearness(distance: Column) -> Column:
    """Weight of a distance between two positions; practically none beyond 100."""
    return F.when(distance > 100, 1e-30).otherwise(1 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2)))


def pair_rank(lists: Column) -> Column:
    """Rank of several lexemes by the nearness of all pairs of positions of different ones. lists: array of arrays."""
    log_miss = F.transform(
        lists,
        lambda a, i: F.aggregate(
            F.slice(lists, i + 2, F.size(lists)),
            F.lit(0.0),
            lambda s, b: s + F.aggregate(a, F.lit(0.0), lambda t, x: t + F.aggregate(b, F.lit(0.0), lambda u, y: u + F.log1p(-WEIGHT * F.sqrt(nearness(F.abs(x - y)))))),
        ),
    )
    return 1 - F.exp(F.aggregate(log_miss, F.lit(0.0), lambda s, x: s + x))


def lexical_rank(lists: Column) -> Column:
    """Relevance of a text by the positions of each query lexeme in it, in the manner of a cover-density-free text rank."""
    return F.when(F.size(lists) == 1, single_rank(lists[0])).when(F.size(lists) > 1, pair_rank(lists)).otherwise(0.0)


_VOWELS = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return i == 0 or not _is_consonant(w, i - 1) if w[i] == "y" else True


def _measure(w: str) -> int:
    kinds = ["c" if _is_consonant(w, i) else "v" for i in range(len(w))]
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(w: str) -> bool:
    return any(not _is_consonant(w, i) for i in range(len(w)))


def _short(w: str) -> bool:
    return len(w) >= 3 and _is_consonant(w, len(w) - 1) and not _is_consonant(w, len(w) - 2) and _is_consonant(w, len(w) - 3) and w[-1] not in "wxy"


#: Suffix rules of steps 2 to 4 of the published suffix-stripping algorithm (fixed values).
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(":")) if ":" in r else (r, "") for r in text.split()), key=lambda r: -len(r[0]))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of an English word by suffix stripping, as published in 1980."""
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + to
            break
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules, least in ((_rules(_STEP2), 1), (_rules(_STEP3), 1), (_rules(_STEP4), 2)):
        for suffix, to in rules:
            if w.endswith(suffix):
                base = w[: len(w) - len(suffix)]
                if _measure(base) >= least and (suffix != "ion" or base[-1:] in ("s", "t")):
                    w = base + to
                break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _english(words) -> list[str | None]:
    return [None if w in STOP_SET else stem(w) for w in words]


STOP_SET = frozenset(STOP_WORDS)


@F.pandas_udf(T.ArrayType(T.StringType()))
def english_lexemes(words: pd.Series) -> pd.Series:
    """Stems of a token array; a stop word becomes null, so that positions keep counting."""
    return words.map(_english, na_action="ignore")


def lexemes(c: Column, language: str = "simple") -> Column:
    """Lexemes of a text in order; in `english` stop words are null."""
    if language == "simple":
        return tokens(c)
    if language != "english":
        raise ValueError(f"no lexemes for {language!r}")
    return english_lexemes(tokens(c))
