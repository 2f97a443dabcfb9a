"""Language of a text, and of the parts of a mixed one.

Each word is scored for every learnt language: log probabilities of its letter n-grams. The script of
its letters narrows the candidates first: languages that never use the script are out. The best labelling of a text's
words under a fixed price for every switch (Viterbi) cuts the text into spans of one
language; the text's language is the one that most letters lie in.

The n-gram counts come from ``LANG_ROWS`` texts a language at most, drawn by hash from the rows that may be
learnt from. They are kept in ``BUCKETS`` buckets, so a model has BUCKETS numbers per language, whatever the
corpus. N-grams are made in bulk, on the code points of many texts at once; the texts of a batch step through
Viterbi together, one word of each at a time.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgermatch.llm.batches import mix, powers_at
from ledgermatch.llm.shared import materialise

#: Texts per language that counts are taken from at most.
LANG_ROWS = 4000
BUCKETS = 1 << 16
#: Letters of the longest n-grams (from 2 on; beginning and end of a word count as one); whole words are counted beside them.
GRAM = 4
#: Added to every count.
SMOOTHING = 0.05
#: A letter lies in several n-grams, so their sum says too much: it is weighed by this.
EVIDENCE = 0.3
#: What a switch of language costs, and a word in a script that a language doesn't use.
SWITCH, OTHER_SCRIPT = 6.0, 60.0
#: Share of a language's letters that a script of its own has at least.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
SEED = 11
#: Letters times languages that are scored at once, and words times languages that step through Viterbi together.
SCORE_CELLS, STEP_CELLS = 1 << 22, 1 << 23

# --- fixed values: first and last code point of the letters of each script ---
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Oriya": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Mongolian": [(0x1800, 0x18AF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
# --- end of fixed values ---
OTHER = len(SCRIPTS)
_WORD = re.compile(r"\S+")
_SIGN, _BLANK, _LETTER = 0, 1, 2
_BEGIN, _END = 1, 2


@functools.cache
def _kinds() -> np.ndarray:
    """For every code point: a sign, a blank, or _LETTER and the number of the script (OTHER where no range holds it)."""
    script = np.full(0x110000, OTHER, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            script[first : last + 1] = i
    out = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        out[code] = _LETTER + script[code] if c.isalpha() else _BLANK if c.isspace() else _SIGN
    return out


def script_of(letter: str) -> int:
    """Number of the script of a letter; OTHER where no range holds it."""
    return int(_kinds()[ord(letter)]) - _LETTER


class Words:
    """The words of some texts: how many each text has, and for each word its letters, script and n-grams.

    A word's letters stand framed in one flat array; a word without letters has no frame.
    """

    def __init__(self, texts: list[str | None]) -> None:
        lowered = [(t or "").lower() for t in texts]
        codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le"), np.uint32)
        kind = _kinds()[codes]
        solid = kind != _BLANK
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        starts = np.flatnonzero(first)
        ends = np.cumsum([len(t) + 1 for t in lowered])
        self.bounds = np.append(0, np.searchsorted(starts, ends))
        at = np.flatnonzero(kind >= _LETTER)
        of = np.cumsum(first)[at] - 1  # word of each letter
        self.letters = np.bincount(of, minlength=len(starts))
        #: The words with letters, and where the frame of each begins.
        self.framed = np.flatnonzero(self.letters)
        sizes = self.letters[self.framed] + 2
        self.heads = np.cumsum(sizes) - sizes
        self.sizes = sizes
        place = np.repeat(np.arange(len(sizes)), sizes - 2)
        flat = np.zeros(int(sizes.sum()), np.uint64)
        flat[self.heads] = _BEGIN
        flat[self.heads + sizes - 1] = _END
        flat[np.arange(len(at)) + 2 * place + 1] = codes[at]
        self.flat = flat
        self.script = self._scripts(kind[at].astype(np.int64) - _LETTER)

    def _scripts(self, script: np.ndarray) -> np.ndarray:
        """The script of most letters of each framed word, of equal ones the first to occur."""
        if not len(self.heads):
            return np.empty(0, np.int64)
        lo = self.heads - 2 * np.arange(len(self.heads))
        out = script[lo]
        for i in np.flatnonzero(np.minimum.reduceat(script, lo) != np.maximum.reduceat(script, lo)):
            mine = script[lo[i] : lo[i] + self.sizes[i] - 2].tolist()
            out[i] = Counter(mine).most_common(1)[0][0]
        return out

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per kind of n-gram its bucket at every place (BUCKETS where none begins), and the first place of each framed word."""
        flat, shift = self.flat, np.uint64(64 - BUCKETS.bit_length() + 1)
        if not len(flat):
            return
        word = np.repeat(np.arange(len(self.heads)), self.sizes)
        grams = flat
        with np.errstate(over="ignore"):
            for n in range(2, GRAM + 1):
                grams = grams[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1 :]
                bucket = np.full(len(flat), BUCKETS, np.int64)
                inside = word[: len(grams)] == word[n - 1 :]
                bucket[: len(grams)] = np.where(inside, (mix(grams + np.uint64(n)) >> shift).astype(np.int64), BUCKETS)
                yield bucket, self.heads
            # Longer words as a whole; where two of them clash they share a bucket, no more.
            whole = np.add.reduceat((flat + np.uint64(1)) * powers_at(np.arange(len(flat)) - self.heads[word]), self.heads)
        yield np.where(self.sizes > GRAM, (mix(whole) >> shift).astype(np.int64), BUCKETS), np.arange(len(self.heads))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, bucket, n); scripts have the buckets from BUCKETS on, their letters are counted."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for lang in set(langs):
            mine = sums.setdefault(lang, np.zeros(BUCKETS + OTHER + 1, np.int64))
            for words, _ in _in_parts((texts[i].as_py() for i, x in enumerate(langs) if x == lang), SCORE_CELLS):
                for bucket, _ in words.buckets():
                    mine[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS + 1)[:BUCKETS]
                mine[BUCKETS:] += np.bincount(words.script, words.sizes - 2, OTHER + 1).astype(np.int64)
    for lang, counted in sums.items():
        used = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(counted[used])], ["lang", "bucket", "n"])


def _in_parts(texts: Iterator[str | None], limit: int) -> Iterator[tuple[Words, list[str | None]]]:
    """Texts in order, in parts of some ``limit`` characters; a larger text is a part by itself."""
    held: list[str | None] = []
    size = 0
    for text in texts:
        if held and size + len(text or "") > limit:
            yield Words(held), held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield Words(held), held


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of doc_id as text leaves 1 when divided by 3 (NULL counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Model:
    """Languages by code point, the log share of each among the rows learnt from, which scripts each uses, and the scores of each bucket."""

    langs: list[str]
    prior: np.ndarray
    scripts: np.ndarray
    table: np.ndarray


def train(docs: DataFrame, rows: int = LANG_ROWS) -> Model:
    """Learn from (doc_id, text, lang) of rows that aren't held out and have a language.

    ``rows`` texts a language are drawn by hash at most, whatever the corpus; how frequent each language is comes from
    all rows. A language without a letter in its texts is learnt by its frequency only.
    """
    dice = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), "text")
    known = docs.where("lang is not null and text is not null").where(~is_held_out(F.col("doc_id"))).select("lang", "text", dice.alias("dice"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("dice"))
    cut = known.select("lang", "dice").distinct().withColumn("number", number).where(F.col("number") <= rows)
    cut = materialise(cut.groupBy("lang").agg(F.max("dice").alias("cut")), "cuts")
    drawn = known.join(cut, "lang").where("dice <= cut").select("lang", "text", "dice").dropDuplicates(["lang", "dice"])
    drawn = materialise(drawn.select("lang", "text"), "sample")
    frequency = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    counted = drawn.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # bounded by BUCKETS
    langs = sorted(frequency)
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((BUCKETS + OTHER + 1, len(langs)))
    for r in counted:
        counts[r.bucket, place[r.lang]] = r.n
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    table = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS))
    total = np.array([frequency[x] for x in langs], float)
    uses = scripts >= SCRIPT_SHARE * np.maximum(1.0, scripts.sum(axis=0))
    scores = np.append(EVIDENCE * table, np.zeros((1, len(langs))), axis=0)  # BUCKETS: no n-gram
    return Model(langs, np.log(total / max(1.0, total.sum())), uses, scores.astype(np.float32))


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Score of every word for every language; the best candidate has 0, words without letters have zeros."""
    out = np.zeros((len(words.letters), len(model.langs)))
    if not len(words.framed):
        return out
    scores = np.zeros((len(words.framed), len(model.langs)), np.float32)
    for bucket, heads in words.buckets():
        scores += np.add.reduceat(model.table[bucket], heads, axis=0) if len(heads) < len(bucket) else model.table[bucket]
    uses = model.scripts[words.script]
    scores -= np.where(uses, scores, -np.inf).max(axis=1, keepdims=True)
    others = np.where(uses, scores, np.inf).min(axis=1, keepdims=True) - OTHER_SCRIPT
    # A script that no language uses tells nothing.
    out[words.framed] = np.where(uses.any(axis=1, keepdims=True), np.where(uses, scores, others), 0.0)
    return out


def best_labels(scores: np.ndarray, bounds: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word, text by text: words of text i are scores[bounds[i]:bounds[i+1]].

    A labelling's worth is the prior of its first language and the scores of all words less ``switch`` for each change. Of equal
    ones staying is taken before a change, and the first language before others.
    """
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    heads, lengths = bounds[:-1][order], n[order]
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")  # texts with a word number t
    state = prior + scores[heads[: alive[0]]]
    final = np.zeros(len(lengths), np.int64)
    back: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(1, lengths[0]):
        k = alive[t]
        final[k : len(state)] = state[k:].argmax(axis=1)
        state = state[:k]
        origin = state.argmax(axis=1)
        moved = (state[np.arange(k), origin] - switch)[:, None]
        back.append((origin, moved > state))
        state = np.maximum(state, moved) + scores[heads[:k] + t]
    final[: len(state)] = state.argmax(axis=1)
    now = final[: alive[-1]]
    for t in range(lengths[0] - 1, -1, -1):
        now = np.concatenate([now, final[len(now) : alive[t]]])
        labels[heads[: alive[t]] + t] = now
        if t:
            origin, moved = back[t - 1]
            now = np.where(moved[np.arange(alive[t]), now], origin, now)
    return labels


def _labelled(texts: list[str | None], bounds: np.ndarray, scores: np.ndarray, letters: np.ndarray, model: Model) -> list[tuple[str, float, list[dict]]]:
    """Language, score and spans of each text; its words are those from bounds[i] to bounds[i+1]."""
    langs = model.langs
    labels = best_labels(scores, bounds, model.prior)
    first = np.ones(len(labels), bool)
    first[1:] = labels[1:] != labels[:-1]
    first[bounds[:-1][bounds[:-1] < len(labels)]] = True
    starts = np.flatnonzero(first)
    if not len(starts):
        return [(UNKNOWN, 0.0, [])] * len(texts)
    spoken, label = np.add.reduceat(letters, starts), labels[starts]
    worth = np.add.reduceat(scores, starts, axis=0) + model.prior
    sure = 1.0 / np.exp(worth - worth[np.arange(len(starts)), label][:, None]).sum(axis=1)
    of = np.searchsorted(bounds, starts, "right") - 1
    by_lang, held = np.zeros((len(texts), len(langs)), np.int64), np.zeros((len(texts), len(langs)))
    np.add.at(by_lang, (of, label), spoken)
    np.add.at(held, (of, label), spoken * sure)
    edges = np.searchsorted(starts, bounds)
    out = []
    for i, text in enumerate(texts):
        total, best = int(by_lang[i].sum()), int(by_lang[i].argmax())
        if not total:
            out.append((UNKNOWN, 0.0, []))
            continue
        lo, hi = int(edges[i]), int(edges[i + 1])
        places = [0]
        if hi - lo > 1:
            begins = [m.start() for m in _WORD.finditer(text or "")]
            places += [begins[s - bounds[i]] for s in starts[lo + 1 : hi]]
        spans = [{"lang": langs[label[lo + j]], "first": a, "last": b} for j, (a, b) in enumerate(zip(places, [*places[1:], len(text or "")], strict=True))]
        out.append((langs[best], min(1.0, float(held[i, best]) / total), spans))
    return out


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def label(text: Column | str, model: Model) -> Column:
    """lang, score and spans of each whole text."""

    @F.arrow_udf("struct<lang:string,score:double,spans:array<struct<lang:string,first:long,last:long>>>")
    def of(column: pa.Array) -> pa.Array:
        out: list[tuple] = []
        held: list[tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if held:
                texts, counts, scores, letters = ([x for part in held for x in part[0]], *(np.concatenate([part[k] for part in held]) for k in (1, 2, 3)))
                out.extend(_labelled(texts, np.append(0, np.cumsum(counts)), scores, letters, model))
                held.clear()

        if not model.langs:
            out = [(UNKNOWN, 0.0, [])] * len(column)
        else:
            cells = 0
            for words, texts in _in_parts((t.as_py() for t in column), SCORE_CELLS // len(model.langs)):
                held.append((texts, np.diff(words.bounds), word_scores(words, model), words.letters))
                cells += len(words.letters) * len(model.langs)
                if cells > STEP_CELLS:
                    flush()
                    cells = 0
            flush()
        lang, score, spans = zip(*out, strict=True) if out else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, _SPANS)], ["lang", "score", "spans"])

    return of(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every document.

    ``lang_pred`` is the learnt language that most letters are labelled with (of equal ones the first by code point),
    ``score`` the share of those letters among all, each span's weighed by the probability of its label. ``spans`` (lang, first, last;
    code points, last exclusive) cover the text. A text that is NULL or has no letter is ``und`` with score 0 and no span; so is
    every text if no language was learnt. Letters of a script that no learnt language uses tell nothing: they go with the words around them.
    Repeated rows come out alike; an empty table gives an empty one.
    """
    found = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), label("text", model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.spans")
