"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density and number of words of two lexicons, second-person words near them, capitals,
punctuation, obfuscated words ("1d10t", "s.c.u.m"), word length and text length. The lexicons are a
short fixed list and, learnt from labelled rows, the words and word beginnings that tell toxic rows from
the others: strong ones hardly occur elsewhere, weak ones occur more often than chance allows. A sample of at
most MAX_ROWS labelled rows (in expectation; a fixed hash of doc_id picks them) is used for fitting; lexicons
and calibration are crossed over PARTS parts of it, so that no row is described or calibrated by what was learnt from
it. Everything is scored: whole texts, all rows.

Defined cases: null text counts as empty; an empty text gets the score of its (all zero) features; a
row without a doc_id is scored and not held out; labels that are null are ignored, of several labels
the highest counts; repeated rows are scored one by one, and one that is labelled counts as often as it stands there. A few rows of a prior
(PRIOR: neutral words, some with insults) are always added to the sample, so trees and calibration are fitted in the same way for any labels, none included.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluier.functions.spans import let
from sluier.llm import workers

#: Labelled rows that are used at most, in expectation.
MAX_ROWS = 12_000
TREES, DEPTH = 10, 3
#: Parts of the sample that lexicons and calibration are crossed over.
PARTS = 3
THRESHOLD = 0.7
#: Toxic rows that a lexicon entry must be seen in, as a number and a share (which bounds the lexicon), and how many times likelier it must be there.
LEAST_ROWS, LEAST_SHARE, LEAST_RATIO = 3, 0.004, 40
#: The same for weak entries, and how many standard deviations beyond chance.
WEAK_SHARE, WEAK_RATIO, WEAK_DEVIATIONS = 0.01, 2.5, 5
#: Lengths of word beginnings.
BEGINNINGS = (3, 4, 5, 6)
#: Words of lexicon tests that a worker remembers.
MAX_WORDS = 100_000
#: Rows of the prior.
PRIOR = 42

# Insults that count in any language's text.
INSULTS = frozenset("clown disgusting dumb fool idiot imbecile jerk loser moron pathetic scum stupid trash worthless".split())
# Second-person words, en de fr es.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# What symbols stand for in obfuscated words.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": "", ".": "", "-": "", "_": ""})

# Neutral words of the prior.
NEUTRAL = "and are day for garden good house it letter morning of one river road the this today water we with you".split()

FEATURES = ["density", "hits", "insults", "distinct", "second_person", "near_hits", "capitals", "exclaims", "punctuation", "obfuscated", "obfuscated_hits", "word_length", "words", "digits", "weak_density", "weak_hits"]

_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(r"[^\W\d_][0-9@$!|*._-]{1,3}(?=[^\W\d_])")
_NO_CAPITALS = bytes(set(range(256)) - set(range(65, 91)))
_NO_DIGITS = bytes(set(range(256)) - set(range(48, 58)))
_NO_PUNCTUATION = bytes(x for x in range(256) if x >= 128 or chr(x).isalnum() or chr(x).isspace())


def _units(word: str) -> list[str]:
    """A word and its beginnings; a beginning ends in *."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


@dataclass(frozen=True)
class Lexicon:
    strong: frozenset[str]
    weak: frozenset[str]


class _Hits(dict):
    """word -> 2 if the strong lexicon has it, 1 if the weak one has it, else 0; bounded."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        units = _units(word)
        found = 2 if word in INSULTS or not self.lexicon.strong.isdisjoint(units) else 1 if not self.lexicon.weak.isdisjoint(units) else 0
        if len(word) < 40:
            self[word] = found
        return found


def text_features(text: str | None, hits: _Hits) -> list[float]:
    lowered = (text or "").lower()
    words = _WORD.findall(lowered)
    n = max(1, len(words))
    marks = list(map(hits.__getitem__, words))
    at = [i for i, mark in enumerate(marks) if mark == 2]
    weak = len(marks) - marks.count(0)
    you = sum(map(SECOND_PERSON.__contains__, words))
    near = sum(any(x in SECOND_PERSON for x in words[max(0, i - 5) : i + 6]) for i in at)
    data = (text or "").encode()
    size = max(1, len(data))
    hidden = hidden_hits = 0
    for found in _HIDDEN.finditer(lowered):
        hidden += 1
        a, b = found.span()
        while a > 0 and found.end() - a < 30 and not lowered[a - 1].isspace():
            a -= 1
        while b < len(lowered) and b - found.start() < 30 and not lowered[b].isspace():
            b += 1
        hidden_hits += hits[lowered[a:b].translate(STANDS_FOR).strip(",;:?\"'()")] == 2
    return [
        len(at) / n,
        np.log1p(len(at)),
        np.log1p(sum(map(INSULTS.__contains__, words))),
        np.log1p(len({words[i] for i in at})),
        you / n,
        near / n,
        len(data.translate(None, _NO_CAPITALS)) / size,
        data.count(b"!") / n,
        len(data.translate(None, _NO_PUNCTUATION)) / size,
        hidden / n,
        np.log1p(hidden_hits),
        sum(map(len, words)) / n,
        np.log1p(len(words)),
        len(data.translate(None, _NO_DIGITS)) / size,
        weak / n,
        np.log1p(weak),
    ]


def features(text: Column, lexicons: list[Lexicon], which: Column) -> Column:
    """array<double> in the order of FEATURES; which: the place of a row's lexicon."""

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        workers.turn("toxicity")
        hits = [_Hits(lexicon) for lexicon in lexicons]
        for texts, places in batches:
            yield pa.array([text_features(x.as_py(), hits[k]) for x, k in zip(texts, places.to_pylist(), strict=True)], pa.list_(pa.float64()))

    return of(text, which)


def units_of(text: Column) -> Column:
    """The different words of a text and their beginnings, as _units() makes them. The text is cut into words once: a generator evaluates what stands in it several times each time."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))

    def begun(cut: Column, n: int) -> Column:
        return F.transform(F.filter(cut, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    return let(words, lambda cut: F.array_distinct(F.concat(cut, *(begun(cut, n) for n in BEGINNINGS))))


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """From (text, label, part): for each part the lexicon of the other parts, and last that of all rows.

    Features of a row that takes part in fitting come from the lexicon that has not seen its part, so
    the trees learn what lexicon words are worth in rows that the lexicon does not know. An entry must be in a share of
    the sample's toxic rows, so what comes to the driver is bounded by the sample and not by the corpus.
    """
    counts = {(r["label"], r["part"]): r["count"] for r in rows.groupBy("label", "part").count().collect()}
    seen = rows.select("label", "part", F.explode(units_of(F.col("text"))).alias("unit"))
    sums = [F.count_if((F.col("label") == k) & (F.col("part") != p)).alias(f"n{k}_{p}") for k in (0, 1) for p in range(PARTS + 1)]
    units = seen.groupBy("unit").agg(*sums)
    marks = []
    for p in range(PARTS + 1):
        toxic, other = (sum(n for (label, part), n in counts.items() if label == k and part != p) for k in (1, 0))
        n1, n0 = F.col(f"n1_{p}"), F.col(f"n0_{p}")
        chance = (n0 + 0.5) / (other + 1)
        ratio = (n1 + 0.5) / (toxic + 1) / chance
        beyond = (n1 - toxic * chance) / F.sqrt(toxic * chance + 0.25)
        strong = (n1 >= max(LEAST_ROWS, LEAST_SHARE * toxic)) & (ratio >= LEAST_RATIO)
        weak = (n1 >= max(LEAST_ROWS, WEAK_SHARE * toxic)) & (ratio >= WEAK_RATIO) & (beyond >= WEAK_DEVIATIONS)
        marks.append(F.when(strong, 2).when(weak, 1).otherwise(0).alias(f"mark_{p}"))
    found = units.select("unit", *marks).filter(F.greatest(*(f"mark_{p}" for p in range(PARTS + 1))) > 0).collect()
    return [Lexicon(*(frozenset(r["unit"] for r in found if r[f"mark_{p}"] == k) for k in (2, 1))) for p in range(PARTS + 1)]


def prior() -> list[tuple[str, int, int]]:
    """(text, label, part) of the prior: texts of 2 to 60 neutral words, every second one with one to four insults among them."""
    insults, rows = sorted(INSULTS), []
    for k in range(PRIOR):
        words = [NEUTRAL[(7 * k + 3 * i) % len(NEUTRAL)] for i in range(2 + 11 * k % 59)]
        for i in range(1 + k // 2 % 4 if k % 2 else 0):
            words.insert((5 * i + k) % (len(words) + 1), insults[(k + 3 * i) % len(insults)])
        rows.append((" ".join(words), k % 2, k // 2 % PARTS))
    return rows


def _prior_rows(spark: SparkSession) -> DataFrame:
    """The prior as rows, from one literal: rows of Python objects would start Python processes of another kind beside the workers of the features."""
    rows = F.from_json(F.lit(json.dumps([dict(zip(("text", "label", "part"), row)) for row in prior()])), "array<struct<text string, label int, part int>>")
    return spark.range(0, 1, 1, 1).select(F.inline(rows))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel
    borders: tuple[float, ...] = ()
    levels: tuple[float, ...] = ()

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with `score` (0 to 1) and `predicted`; columns of these names are replaced."""
        rows = docs.withColumn("__features", features(F.col(text), [self.lexicon], F.lit(0)))
        rows = self.trees.transform(rows.withColumn("__features", array_to_vector("__features")))
        raw = vector_to_array("__probability")[1]
        rows = rows.withColumn("score", self._calibrated(raw)).drop("__features", "__raw", "__probability", "__class")
        return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

    def _calibrated(self, raw: Column) -> Column:
        """The isotonic steps, straight lines between their borders."""
        x, y = self.borders, self.levels
        if not x:
            return raw
        out = F.when(raw <= x[0], F.lit(y[0]))
        for (a, b), (c, d) in zip(zip(x, x[1:]), zip(y, y[1:])):
            out = out.when(raw <= b, F.lit(c) + (raw - a) * ((d - c) / (b - a) if b > a else 0.0))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out.otherwise(F.lit(y[-1]))))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Fit on labels (doc_id, toxic) of rows that are not held out."""
    place = F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))
    known = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(place, F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    # At most max_rows rows in expectation, so the broadcast is bounded.
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    rows = rows.select("text", "label", F.pmod(F.shiftright(place, 30), F.lit(PARTS)).cast("int").alias("part")).persist()
    *crossed, whole = learn_lexicons(rows)
    every = rows.unionByName(_prior_rows(docs.sparkSession))
    table = every.select(F.col("label").cast("double").alias("label"), "part", array_to_vector(features(F.col("text"), crossed, F.col("part"))).alias("__features")).repartition(4).persist()
    gbt = GBTClassifier(featuresCol="__features", labelCol="label", predictionCol="__class", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=3, seed=7)
    gbt = gbt.setProbabilityCol("__probability").setRawPredictionCol("__raw")
    # Each part is calibrated by trees that have not seen it.
    calibration = None
    for p in range(PARTS):
        told = gbt.fit(table.filter(F.col("part") != p)).transform(table.filter(F.col("part") == p)).select("label", vector_to_array("__probability")[1].alias("raw"))
        calibration = told if calibration is None else calibration.unionByName(told)
    model = ToxicityModel(whole, gbt.fit(table))
    iso = IsotonicRegression(featuresCol="raw", labelCol="label").fit(calibration)
    model.borders, model.levels = tuple(map(float, iso.boundaries)), tuple(map(float, iso.predictions))
    table.unpersist()
    rows.unpersist()
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = fit(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; the columns stay."""
    scored = fit(docs, labels).score(docs.withColumn("__kept", F.struct(*(F.col(f"`{c}`") for c in docs.columns))).select("__kept", F.col("text").alias("__text")), "__text")
    return scored.filter("predicted = 0").select("__kept.*")
