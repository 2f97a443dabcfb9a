"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are a dozen numbers per text: density and strength of a lexicon's words, how near they stand
to the second person, capitals, punctuation and obfuscated spellings. The lexicon is learnt from
the labelled training texts (whole words and word beginnings that toxic texts hold far more
often) beside a short fixed list.

Training takes ``TRAIN_ROWS`` labelled texts at most, chosen by hash of doc_id. Each text's
features come from a lexicon learnt on the other folds, so the trees see words as they will
meet them in new texts. Trees are fit on one part and calibrated on the rest. Scoring reads every text
once, whole; trees and calibration run as Spark ML models.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.shared import materialise

#: Labelled texts that are used for training at most.
TRAIN_ROWS = 12_000
#: Entries of a learnt lexicon at most, the strongest.
LEXICON_ROWS = 4_000
#: Texts with a word that the lexicon needs.
SUPPORT = 3
FOLDS = 3
TREES, DEPTH, STEP = 20, 3, 0.3
SEED = 7

#: Fixed list, in natural order.
INSULTS = "bastard clown cretin disgusting dumb fool garbage idiot imbecile loser moron pathetic scum stupid trash ugly vermin worthless".split()
#: Words of the second person in the languages that the texts come in.
SECOND_PERSON = set("du dich dir dein deine euch ihr te ti tu tú toi ton ta tes usted ustedes vos vosotros vous votre u ur you your yours yourself".split())

_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = re.compile(r"^[^\w@$]+|[^\w]+$")
_ODD = re.compile(r"[^\W\d_][*.@$!0-9_-]+[^\W\d_]")
_DROP = re.compile(r"[\W_]+")

FEATURES = ["log_words", "strongest", "second", "n_strong", "n_distinct", "per_100", "sum_weight", "near_person", "capital_letters", "capital_words", "marks", "odd_words", "odd_strong"]
STRONG = 2.0


def spellings(word: str) -> tuple[str, ...]:
    """The forms under which a lexicon may hold a word: plain, without obfuscation, and its beginnings."""
    plain = _EDGE.sub("", word.lower())
    if not plain:
        return ()
    clear = _DROP.sub("", plain.translate(_LEET)) if _ODD.search(plain) else plain
    return tuple(dict.fromkeys((plain, clear, *(f"{clear[:n]}~" for n in (4, 5) if len(clear) > n))))


@F.arrow_udf(T.ArrayType(T.StringType()))
def vocabulary(text: pa.Array) -> pa.Array:
    """The different spellings in each whole text."""
    return pa.array([list({s for w in set((t.as_py() or "").split()) for s in spellings(w)}) for t in text], pa.list_(pa.string()))


def learn_lexicon(counted: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log odds of the spellings (columns word, toxic, clean: numbers of texts) that speak for label 1."""
    a, b = F.col("toxic"), F.col("clean")
    odds = F.log((a + 0.5) / (n_toxic + 1.0)) - F.log((b + 0.5) / (n_clean + 1.0))
    best = counted.withColumn("weight", odds).where((a >= SUPPORT) & (F.col("weight") > 1.0))
    rows = best.orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "word").limit(LEXICON_ROWS).collect()
    fixed = {w: STRONG for w in INSULTS}
    return fixed | {r.word: r.weight for r in rows}


@dataclass
class _Words(dict):
    """Word to the number of its kind (weight, second person, capitals, obfuscated); kinds are few."""

    lexicon: dict[str, float]
    kinds: dict[tuple, int] = field(default_factory=dict)

    def __missing__(self, word: str) -> int:
        forms = spellings(word)
        weight = max((self.lexicon.get(f, 0.0) for f in forms), default=0.0)
        odd = bool(_ODD.search(word)) and len(forms) > 0
        kind = (round(weight, 1), bool(forms) and forms[0] in SECOND_PERSON, len(word) > 2 and word.isupper(), odd)
        if len(self) > 500_000:
            self.clear()  # only a cache
        self[word] = self.kinds.setdefault(kind, len(self.kinds))
        return self[word]


def _features(text: str, known: _Words) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    numbers = np.fromiter(map(known.__getitem__, words), np.int64, n)
    table = np.array([(w, p, c, o) for w, p, c, o in known.kinds], float)
    weight, person, capital, odd = table[numbers].T
    strong = np.flatnonzero(weight >= STRONG)
    near = 0.0
    if len(strong):
        people = np.flatnonzero(person)
        if len(people):
            at = np.searchsorted(people, strong)
            gap = np.minimum(np.abs(people[np.minimum(at, len(people) - 1)] - strong), np.abs(people[np.maximum(at - 1, 0)] - strong))
            near = float((gap <= 5).mean())
    top = np.partition(weight, -2)[-2:] if n > 1 else np.array([0.0, weight[0]])
    content = text.encode()
    signs = np.bincount(np.frombuffer(content, np.uint8), minlength=256)
    letters = max(1, int(signs[65:91].sum() + signs[97:123].sum()))
    return [
        math.log1p(n), float(top[1]), float(top[0]), float(len(strong)), float(len({words[i] for i in strong.tolist()})), 100.0 * len(strong) / n,
        float(weight.sum() / math.sqrt(n)), near, float(signs[65:91].sum() / letters), float(capital.mean()), float((signs[33] + signs[63]) / n),
        float(odd.mean()), float(odd[strong].sum()),
    ]


def features(text: Column | str, lexicon: dict[str, float]) -> Column:
    """FEATURES of each whole text, as array of doubles; zeros for NULL and for texts without words."""
    held = text if isinstance(text, Column) else F.col(text)

    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        known = _Words(lexicon)
        return pa.array([_features(t.as_py() or "", known) for t in column], pa.list_(pa.float64()))

    return of(held)


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of doc_id as text divisible by 5 (NULL counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    """A lexicon, trees and the calibration of their score; without trees the ``base`` rate for all."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None
    base: float = 0.0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled texts that aren't held out.

    A doc_id with several labels is toxic if one of them says so; labels that are NULL don't count. With fewer than
    two texts of each label there is nothing to learn and the rate of label 1 is the score.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    dice = F.xxhash64(F.lit(SEED), "doc_id")
    drawn = known.where(~is_held_out(F.col("doc_id"))).orderBy(dice, "doc_id").limit(rows)
    fold = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(FOLDS)).cast("int")
    sample = materialise(docs.select("doc_id", "text").join(drawn, "doc_id").select("text", F.col("y").cast("int").alias("y"), fold.alias("fold"), F.pmod(F.xxhash64(F.lit(SEED + 2), "doc_id"), F.lit(10)).alias("tenth")), "sample")
    size = Counter({(r.fold, r.y): r["count"] for r in sample.groupBy("fold", "y").count().collect()})
    toxic, clean = (sum(n for (_, y), n in size.items() if y == label) for label in (1, 0))
    if min(toxic, clean) < 2:
        return Model({w: STRONG for w in INSULTS}, base=toxic / max(1, toxic + clean))
    words = sample.select("y", "fold", F.explode(vocabulary("text")).alias("word"))
    per_fold = [F.count_if((F.col("fold") == k) & (F.col("y") == y)).alias(f"f{k}_{y}") for k in range(FOLDS) for y in (0, 1)]
    counted = materialise(words.groupBy("word").agg(*per_fold).where(" + ".join(f"f{k}_1" for k in range(FOLDS)) + f" >= {SUPPORT}"), "words")

    def lexicon(without: int | None) -> dict[str, float]:
        use = [k for k in range(FOLDS) if k != without]
        total = lambda y: sum((F.col(f"f{k}_{y}") for k in use), F.lit(0))
        return learn_lexicon(counted.select("word", total(1).alias("toxic"), total(0).alias("clean")), *(sum(size[k, y] for k in use) for y in (1, 0)))

    parts = [sample.where(F.col("fold") == k).select("y", "tenth", array_to_vector(features("text", lexicon(k))).alias("features")) for k in range(FOLDS)]
    table = materialise(parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("label", F.col("y").cast("double")), "features")
    fit, rest = table.where("tenth < 7"), table.where("tenth >= 7")
    if fit.select("label").distinct().count() < 2 or rest.select("label").distinct().count() < 2:
        fit = rest = table
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED).fit(fit)
    raw = trees.transform(rest).select("label", vector_to_array("probability")[1].alias("raw"))
    return Model(lexicon(None), trees, IsotonicRegression(featuresCol="raw").fit(raw), toxic / (toxic + clean))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and score (0 to 1) of every document.

    A score depends on the text only. NULL or empty text: all features zero, scored like any other.
    Repeated rows come out alike; an empty table gives an empty one.
    """
    about = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), features("text", model.lexicon).alias("dense"))
    if model.trees is None or model.calibration is None:
        return about.select("doc_id", "held_out", F.lit(model.base).alias("score"))
    scored = model.trees.transform(about.withColumn("features", array_to_vector("dense")))
    scored = model.calibration.transform(scored.withColumn("raw", vector_to_array("probability")[1]).drop("prediction"))
    return scored.select("doc_id", "held_out", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")).alias("score"))
