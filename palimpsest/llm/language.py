"""Language of documents and of the segments of mixed ones, by a linear-chain conditional random field over words.

Words are labelled with a language or with none (names, code, noise). Features of a word are itself, its affixes, its
letter n-grams, its script and its capital; transitions are learned, apart for neighbours within a sentence and across
its end. The field is fitted on a bounded sample of labelled documents, whose labels may be wrong: before fitting, the
sample's sentences are relabelled by a few rounds of word counting, so that a wrong label is outvoted. Forward-backward
runs over all chains of a block of texts in step. Segments are runs of words with one label, with the mean posterior of
their words as confidence: a sentence that changes its language gives several, neighbouring sentences of one language
give one. Texts in a language outside `LANGUAGES` are labelled with one of these or with none.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.scan import LETTER, NUMBER, SPACE, Block, blocks, class_table, distinct_slices, ragged

#: Languages with their codes of three letters and English names (fixed values).
LANGUAGES = {
    "de": ("deu", "ger", "german"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish"),
    "fr": ("fra", "fre", "french"),
    "it": ("ita", "italian"),
    "ja": ("jpn", "japanese"),
    "nl": ("nld", "dut", "dutch"),
    "pl": ("pol", "polish"),
    "pt": ("por", "portuguese"),
    "ru": ("rus", "russian"),
}
NAMES = [*LANGUAGES, ""]
NONE = len(LANGUAGES)
#: Documents of each labelled language that the field is fitted on, if there are as many; their words at most.
FIT_DOCUMENTS, FIT_WORDS = 60, 300_000
#: So many times the documents wanted are drawn by a hash; those with the smallest hashes stay.
OVERSAMPLE = 5
#: Longer texts are not taken into the sample, which bounds its size on the driver.
FIT_CHARS = 20_000
#: Weights of the feature table, and rounds of fitting.
FEATURES, ROUNDS = 1 << 15, 20
#: Words of a chain; a longer line is worked through in pieces that see so many words of the line on either side, after
#: which the labels no longer depend on what lies beyond.
CHAIN, HALO = 256, 64
#: A run of one language has at least so many words, and this share of the labelled words in its stretch.
LEAST_WORDS, LEAST_SHARE = 3, 0.7
#: Ends of sentences: these before white space or the end of the text, and these anywhere (fixed values).
STOPS, STOPS_ANYWHERE = ".?!…", "。？！"
#: A stretch between white space with any of these or a digit holds no words (fixed values).
NOISE = "_/=&%@\\{}<>|~^$+[]()"
WORDS_KEPT = 150_000


def named_language(label: Column) -> Column:
    """The language that a label names: a code of two or three letters, with or without a region, or an English name, in
    any case, blanks around it ignored. Null for every other label and for none."""
    clean = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    codes = {x: two for two, (*threes, _) in LANGUAGES.items() for x in (two, *threes)}
    names = {name: two for two, (*_, name) in LANGUAGES.items()}
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    base = F.regexp_extract(clean, r"^([a-z]{2,3})(?:[-_][a-z0-9]{2,8})*$", 1)
    return F.coalesce(F.try_element_at(table(codes), base), F.try_element_at(table(names), clean))


@dataclass
class Words:
    """Words of a block in order: code-point start and end, text, sentence and line of each; each distinct word once."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray
    line: np.ndarray
    uid: np.ndarray
    distinct: list[str]
    sentence_start: np.ndarray
    sentence_end: np.ndarray


def _ideographs(cp: np.ndarray) -> np.ndarray:
    return ((cp >= 0x3005) & (cp <= 0x3007)) | ((cp >= 0x3040) & (cp <= 0x30FF)) | ((cp >= 0x3400) & (cp <= 0x9FFF)) | ((cp >= 0xF900) & (cp <= 0xFAFF)) | ((cp >= 0x20000) & (cp < 0x32000))


def _fenced(b: Block, first: np.ndarray) -> np.ndarray:
    """Which code points lie in fenced code: between a line that starts with three backticks and the next such line of
    the same text. A fence without another after it is none."""
    cp, n = b.cp, len(b.cp)
    out = np.zeros(n, bool)
    tick = np.flatnonzero((cp == 0x60) & (first | (np.append(0, cp[:-1]) == 0x0A)))
    tick = tick[tick + 2 < n]
    tick = tick[(cp[tick + 1] == 0x60) & (cp[tick + 2] == 0x60)]
    doc = np.searchsorted(b.doc, tick, "right") - 1
    rank = np.arange(len(tick)) - np.searchsorted(doc, doc)
    opens = np.flatnonzero((rank % 2 == 0) & np.append(doc[1:] == doc[:-1], np.zeros(min(1, len(tick)), bool)))
    step = np.zeros(n + 1, np.int32)
    step[tick[opens]] += 1
    step[tick[opens + 1]] -= 1
    np.not_equal(np.cumsum(step[:-1]), 0, out=out)
    return out


def find_words(b: Block) -> Words:
    """Runs of letters; an ideograph or kana is a word of its own."""
    cp, n = b.cp, len(b.cp)
    cls = class_table()[cp]
    first = b.text_starts()
    last = np.append(first[1:], True)
    space = cls == SPACE
    before_space = np.append(space[1:], True) | last
    line_end = (cp == 0x0A) | last
    stop = (np.isin(cp, [ord(c) for c in STOPS]) & before_space) | np.isin(cp, [ord(c) for c in STOPS_ANYWHERE]) | line_end
    sentence_of = np.cumsum(np.append(False, stop[:-1]))
    line_of = np.cumsum(np.append(False, line_end[:-1]))
    # stretches between white space, and whether they hold noise
    lead = ~space & (first | np.append(True, space[:-1]))
    stretch = np.maximum(np.cumsum(lead) - 1, 0)
    at = np.flatnonzero(lead)
    noise_cp = (cls == NUMBER) | np.isin(cp, [ord(c) for c in NOISE])
    noisy = np.logical_or.reduceat(noise_cp, at) if len(at) else np.zeros(0, bool)
    letter = cls == LETTER
    ideo = _ideographs(cp) & letter
    run = letter & ~ideo
    start = np.flatnonzero((run & (first | np.append(True, ~run[:-1]))) | ideo)
    end = np.flatnonzero((run & np.append(first[1:] | ~run[1:], True)) | ideo) + 1
    keep = ideo[start] | ~noisy[stretch[start]] if len(start) else np.zeros(0, bool)
    keep &= ~_fenced(b, first)[start]
    start, end = start[keep], end[keep]
    sentence, line = sentence_of[start], line_of[start]
    if len(start):
        pick, uid = distinct_slices(b.data, b.byte[start], b.byte[end])
        raw = b.data.tobytes()
        distinct = [raw[i:j].decode() for i, j in zip(b.byte[start[pick]].tolist(), b.byte[end[pick]].tolist(), strict=True)]
    else:
        uid, distinct = np.zeros(0, np.int64), []
    begins = np.flatnonzero(np.append(True, stop[:-1])) if n else np.zeros(0, np.int64)
    ends = np.append(begins[1:], n)
    doc = np.searchsorted(b.doc, start, "right") - 1
    return Words(start, end, doc, sentence, line, uid, distinct, begins, ends)


def chains(line: np.ndarray, halo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, chain, own) for each place of the chains that lines are cut into: own is false for the words of the halo."""
    n = len(line)
    head = np.flatnonzero(np.append(True, line[1:] != line[:-1])[:n])
    stop = np.append(head[1:], n)
    pieces = -(-(stop - head) // CHAIN)
    head, stop = np.repeat(head, pieces), np.repeat(stop, pieces)
    s = head + CHAIN * ragged(np.zeros(len(pieces), np.int64), pieces)
    e = np.minimum(s + CHAIN, stop)
    a, b = np.maximum(s - halo, head), np.minimum(e + halo, stop)
    word, chain = ragged(a, b - a), np.repeat(np.arange(len(a)), b - a)
    return word, chain, (word >= s[chain]) & (word < e[chain])


def features(word: str) -> list[int]:
    """Numbers of a word's features: lexicon, affixes, n-grams, script, capital."""
    w = word.lower()
    edged = f"^{w}$"
    names = [f"w{w}", f"c{word[:1].isupper()}", f"u{ord(w[0]) >> 7}"]
    names += [f"p{w[:n]}" for n in (1, 2, 3)] + [f"s{w[-n:]}" for n in (1, 2, 3)]
    names += [edged[i : i + n] for n in (2, 3) for i in range(len(edged) - n + 1)]
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


def feature_lists(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words one after another, number of each word's)."""
    lists = [features(w) for w in distinct]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for f in lists for x in f), np.int64, int(size.sum())), size


@dataclass
class Field:
    """Weights of features and log weights of starts and of transitions within and across sentences."""

    weight: np.ndarray
    start: np.ndarray
    inner: np.ndarray
    across: np.ndarray


def forward_backward(emit: np.ndarray, chain: np.ndarray, sentence: np.ndarray, field: Field, expect: bool = False):
    """Posterior of each label for each word; with `expect` also the expected starts and transitions.

    `emit` holds the log weights of the labels for each word. All chains are worked through in step, longest first, so
    nothing is padded.
    """
    n, k = emit.shape
    e = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float32)
    start, inner, across = (np.exp(x - x.max()).astype(np.float32) for x in (field.start, field.inner, field.across))
    head = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    length = np.diff(np.append(head, n))
    order = np.argsort(-length, kind="stable")
    head, length = head[order], length[order]
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    crosses = np.append(False, sentence[1:] != sentence[:-1])
    alpha, beta = np.empty((n, k), np.float32), np.ones((n, k), np.float32)
    a = start * e[head]
    alpha[head] = a / a.sum(1, keepdims=True)
    for t in range(1, int(length[0])):
        at = head[: live[t]] + t
        before = alpha[at - 1]
        a = before @ inner
        x = crosses[at]
        if x.any():
            a[x] = before[x] @ across
        a *= e[at]
        alpha[at] = a / np.maximum(a.sum(1, keepdims=True), 1e-30)
    sums = [np.zeros((k, k)), np.zeros((k, k))]
    for t in range(int(length[0]) - 1, 0, -1):
        at = head[: live[t]] + t
        y = beta[at] * e[at]
        x = crosses[at]
        b = y @ inner.T
        if x.any():
            b[x] = y[x] @ across.T
        if expect:
            before = alpha[at - 1] / np.maximum((alpha[at - 1] * b).sum(1, keepdims=True), 1e-30)
            sums[0] += (before[~x].T @ y[~x]) * inner
            sums[1] += (before[x].T @ y[x]) * across
        beta[at - 1] = b / np.maximum(b.sum(1, keepdims=True), 1e-30)
    post = alpha * beta
    post /= np.maximum(post.sum(1, keepdims=True), 1e-30)
    return (post, post[head].sum(0), *sums) if expect else post


def _count(rows: np.ndarray, labels: np.ndarray, weights, shape) -> np.ndarray:
    return np.bincount(rows * shape[1] + labels, weights, shape[0] * shape[1]).reshape(shape)


def clean_labels(w: Words, label: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A language for each sentence (NONE where its words are unknown or undecided), from the documents' labels.

    Words are counted under the labels of their sentences, sentences are relabelled by those counts, and so on. Then a
    word is none if it is rare and capital, or a sentence of none holds it.
    """
    n_words, n_langs = len(w.distinct), NONE
    folded = {}
    uid = np.array([folded.setdefault(x.lower(), len(folded)) for x in w.distinct], np.int64)[w.uid]
    n_words = len(folded)
    sentences, sid = np.unique(w.sentence, return_inverse=True)
    by = np.zeros(len(sentences), np.int64)
    by[sid] = label[w.doc]
    for _ in range(rounds):
        known = by[sid] < NONE
        c = _count(uid[known], by[sid][known], None, (n_words, n_langs))
        total = np.maximum(c.sum(0), 1)
        rate = (c + 0.05) / (total + 0.05 * n_words)
        score = np.log(rate) - np.log(rate.mean(1, keepdims=True))  # what a word says beyond how common it is
        score[c.sum(1) < 3] = 0
        votes = np.zeros((len(sentences), n_langs))
        for k in range(n_langs):
            votes[:, k] = np.bincount(sid, score[uid, k], len(sentences))
        informed = np.bincount(sid, score[uid].max(1) > 0.5, len(sentences))
        words = np.bincount(sid, minlength=len(sentences))
        ranked = np.sort(votes, 1)
        sure = (ranked[:, -1] - ranked[:, -2] > 2) & (informed >= 2) & (informed >= 0.4 * words)
        by = np.where(sure, votes.argmax(1), NONE)
    gold = by[sid]
    spread = (c > 0).sum(1)
    common = c.sum(1) >= 3
    capital = np.array([x[:1].isupper() for x in w.distinct], bool)[w.uid]
    # a word that many languages share about equally says nothing; with a capital it is taken for a name
    flat = score.max(1) < 0.7
    gold = np.where(capital & (~common | (flat & (spread > 3)))[uid], NONE, gold)
    return gold


def fit(texts: list[str], labels: list[str], rounds: int = ROUNDS) -> Field:
    """The field of a sample of labelled texts, by maximum likelihood with Adam."""
    k = NONE + 1
    zero = Field(np.zeros((FEATURES, k), np.float32), np.zeros(k), np.zeros((k, k)), np.zeros((k, k)))
    joined = pa.array(texts, pa.large_string())
    parts = [(row, find_words(Block(d, o))) for row, _, d, o in blocks(joined, 1 << 40) if len(d)]
    if not parts or not len(parts[0][1].start):
        return zero
    w = parts[0][1]
    label = np.array([NAMES.index(x) for x in labels], np.int64)
    gold = clean_labels(w, label)
    flat, size = feature_lists(w.distinct)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(flat, kind="stable")
    by_feature = owner[order]
    used, cuts = np.unique(flat[order], return_index=True)
    scale = 1.0 / np.sqrt(size)[:, None]
    params = [np.zeros((len(used), k)), np.zeros(k), np.zeros((k, k)), np.zeros((k, k))]
    slot = np.searchsorted(used, flat)
    _, chain, _ = chains(w.line, 0)
    head = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    inside = np.append(False, chain[1:] == chain[:-1])
    crosses = np.append(False, w.sentence[1:] != w.sentence[:-1])
    seen_start = np.bincount(gold[head], minlength=k)
    seen = [_count(gold[np.flatnonzero(m) - 1], gold[m], None, (k, k)) for m in (inside & ~crosses, inside & crosses)]
    seen_word = _count(w.uid, gold, None, (len(size), k))
    times = np.bincount(w.uid, minlength=len(size))
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    ends = np.cumsum(size) - size
    n = len(gold)
    for t in range(1, rounds + 1):
        emit = np.add.reduceat(params[0][slot], ends, axis=0) * scale
        post, starts, inner, across = forward_backward(emit[w.uid], chain, w.sentence, Field(params[0], *params[1:]), expect=True)
        expected = np.column_stack([np.bincount(w.uid, post[:, j], len(size)) for j in range(k)])
        error = (seen_word - expected) / np.sqrt(times)[:, None]  # common words don't drown the others
        grads = [np.add.reduceat((error * scale)[by_feature], cuts, axis=0), (seen_start - starts) / len(head), *((s - x) / n for s, x in zip(seen, (inner, across), strict=True))]
        for i, g in enumerate(grads):
            g = g - 1e-4 * params[i] * (1 if i else 10)
            first[i] = 0.8 * first[i] + 0.2 * g
            second[i] = 0.95 * second[i] + 0.05 * g * g
            params[i] += (0.35 if i == 0 else 0.2) * (first[i] / (1 - 0.8**t)) / (np.sqrt(second[i] / (1 - 0.95**t)) + 1e-9)
    weight = zero.weight
    weight[used] = params[0]
    return Field(weight, *params[1:])


class Labeller:
    """Applies a field to blocks of texts; keeps the weights of words it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, NONE + 1), np.float32)

    def _emissions(self, distinct: list[str]) -> np.ndarray:
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = distinct
        if new:
            flat, size = feature_lists(new)
            rows = np.add.reduceat(self.field.weight[flat], np.cumsum(size) - size, axis=0) / np.sqrt(size)[:, None]
            at = len(self.known)
            while at + len(new) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(new)] = rows
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        return self.table[np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))]

    def posteriors(self, w: Words) -> np.ndarray:
        """Posterior of each label for each word."""
        word, chain, own = chains(w.line, HALO)
        return forward_backward(self._emissions(w.distinct)[w.uid[word]], chain, w.sentence[word], self.field)[own]

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """The runs of one language of a block, in order: doc (row), start and end (code points within the text), lang
        (number), words that have it, their summed posterior, and whole: whether it is the only one of its sentence.

        Words of none don't break a run. Within a sentence, runs of one word, then those of fewer than LEAST_WORDS, are
        dissolved, which joins the runs around them; a run ends where the next one or the next sentence starts.
        """
        b = Block(data, offsets)
        w = find_words(b)
        none = {x: np.zeros(0, np.int64) for x in ("doc", "start", "end", "lang", "words")} | {"sure": np.zeros(0), "whole": np.zeros(0, bool)}
        if not len(w.start):
            return none
        post = self.posteriors(w)
        label = post.argmax(1)
        labelled = np.flatnonzero(label < NONE)
        at = labelled
        for least in range(1, LEAST_WORDS + 1):
            s, lang = w.sentence[at], label[at]
            run = np.cumsum(np.append(True, (s[1:] != s[:-1]) | (lang[1:] != lang[:-1]))[: len(at)]) - 1
            size = np.bincount(run)
            long = size >= least
            at, run = at[long[run]], run[long[run]]
        if not len(at):
            return none
        s, lang = w.sentence[at], label[at]
        head = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (lang[1:] != lang[:-1])))
        words = np.diff(np.append(head, len(at)))
        sure = np.add.reduceat(post[at, lang], head)
        word, s, lang = at[head], s[head], lang[head]
        m = len(head)
        opens, closes = np.append(True, s[1:] != s[:-1]), np.append(s[1:] != s[:-1], True)
        # which run's stretch each labelled word lies in; the first run of a sentence also has the words before it
        r = np.searchsorted(word, labelled, "right") - 1
        sentence = w.sentence[labelled]
        r = np.where((r >= 0) & (s[r] == sentence), r, np.minimum(r + 1, m - 1))
        owned = np.bincount(r[s[r] == sentence], minlength=m)
        start = np.where(opens, w.sentence_start[s], w.start[word])
        end = np.where(closes, w.sentence_end[s], np.append(w.start[word[1:]], 0))
        keep = words >= LEAST_SHARE * owned
        doc = w.doc[word]
        base = b.doc[doc]
        out = {"doc": doc, "start": start - base, "end": end - base, "lang": lang, "words": words, "sure": sure, "whole": opens & closes}
        return {k: v[keep] for k, v in out.items()}


def sample_rate(rows: int, documents: int) -> int:
    """The hash, as a number from 0 to 2**63 - 1, below which OVERSAMPLE times `documents` of `rows` lie, about."""
    return min((1 << 63) - 1, (OVERSAMPLE * documents << 63) // max(1, rows))


def fit_sample(df: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", documents: int = FIT_DOCUMENTS) -> Field:
    """The field fitted on `documents` rows of each language named by the labels (all of a language with fewer): those
    with the smallest hashes of id and text among the texts of up to FIT_CHARS. A table without any such row gives a field
    that knows nothing; a drawing that misses all of them is an error."""
    named = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), named_language(F.col(label)).alias("lang")).where("lang is not null and text <> ''").where(F.length("text") <= FIT_CHARS)
    have = {r.lang: r.n for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a language
    if not have:
        return fit([], [])
    rate = F.create_map(*[F.lit(x) for lang, n in have.items() for x in (lang, sample_rate(n, documents))])
    drawn = named.withColumn("h", F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 63) - 1))).where(F.col("h") <= F.try_element_at(rate, F.col("lang")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))  # each task keeps its first `documents`
    rows = sorted(drawn.withColumn("nth", first).where(F.col("nth") <= documents).select("h", "text", "lang").collect())
    if not rows:
        raise RuntimeError(f"no labelled text was drawn of {sum(have.values())}")
    texts, labels, words = [], [], 0
    for r in rows:
        words += len(r.text) // 5
        if words > FIT_WORDS and texts:
            break
        texts.append(r.text)
        labels.append(r.lang)
    return fit(texts, labels)


def label_segments(df: DataFrame, field: Field, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The segments of every text: id, columns of `keep`, segment (from 0), start, end (code points), lang, confidence,
    sentences (whole ones in it), words. A stretch without a language is in no segment. A null, empty or wordless text has
    no segments. Repeated rows give their segments twice."""
    from pyspark.sql import types as T

    narrow = df.select(F.col(id_col).alias("k0"), *[F.col(c).alias(f"k{i + 1}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    out = [T.StructField(n, t) for n, t in (("segment", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("lang", T.StringType()), ("confidence", T.DoubleType()), ("sentences", T.IntegerType()), ("words", T.IntegerType()))]
    schema = T.StructType([*narrow.schema.fields[:-1], *out])
    shared = df.sparkSession.sparkContext.broadcast(field)  # a table of fixed size

    def run(batches):
        labeller = Labeller(shared.value)
        names = pa.array(NAMES)
        for b in batches:
            for row, _, data, offsets in blocks(b.column("t")):
                if not len(data):
                    continue
                s = labeller.runs(data, offsets)
                m = len(s["doc"])
                if not m:
                    continue
                new_doc = np.append(True, s["doc"][1:] != s["doc"][:-1])
                cut = new_doc | np.append(True, s["lang"][1:] != s["lang"][:-1])
                at = np.flatnonzero(cut)
                words = np.add.reduceat(s["words"], at)
                number = np.arange(len(at)) - np.maximum.accumulate(np.where(new_doc[at], np.arange(len(at)), 0))
                end = s["end"][np.append(at[1:], m) - 1]
                who = b.take(pa.array(s["doc"][at] + row))
                yield pa.RecordBatch.from_arrays(
                    [
                        *who.columns[:-1],
                        pa.array(number.astype(np.int32)),
                        pa.array(s["start"][at].astype(np.int32)),
                        pa.array(end.astype(np.int32)),
                        names.take(pa.array(s["lang"][at])),
                        pa.array(np.add.reduceat(s["sure"], at) / words),
                        pa.array(np.add.reduceat(s["whole"], at, dtype=np.int32)),
                        pa.array(words.astype(np.int32)),
                    ],
                    schema=None,
                    names=[f.name for f in schema.fields],
                )

    return narrow.mapInArrow(run, schema).toDF(id_col, *keep, *[f.name for f in out])


def document_languages(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The main language of each document that has one (most words, then by name), its confidence and share of words."""
    per = segments.groupBy(id_col, "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))
    top = F.max_by(F.struct("lang", "confidence", "words"), F.struct("words", "lang"))
    return per.groupBy(id_col).agg(top.alias("t"), F.sum("words").alias("all")).select(id_col, "t.lang", "t.confidence", (F.col("t.words") / F.col("all")).alias("share"))
