"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings that mark toxic rows is learned from labelled rows, in
two halves, so that the trees are fitted on features from the half a row is not in. Features
are densities of lexicon words, their nearness to the second person, capitals, punctuation and
obfuscated spellings. Trees are fitted on three quarters of the labelled rows and calibrated on
the rest; a row's score is the calibrated probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from .tables import hashed_sample, mapped, portions

# Insults that count without being learned, second persons, look-alike characters.
INSULTS = "idiot moron loser scum trash clown stupid pathetic worthless disgusting".split()
SECOND = "you your yours yourself du dich dir dein deine euch tu te toi vous votre vos tus ti usted ustedes vosotros".split()
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

#: Most labelled rows to fit on, first by hash of their id.
SAMPLE = 20_000
#: Most lexicon entries, and the shortest and longest beginnings of words among them.
LEXICON = 400
PREFIXES = (4, 5, 6, 7)
#: Log-odds and rows from which an entry is kept, and log-odds from which a word with it is a hit.
LEAST_ODDS = math.log(6)
LEAST_ROWS = 4
HIT_ODDS = math.log(30)
THRESHOLD = 0.3
NAMES = (
    "log_words insult_density hits hit_density strongest weight weak_hits weak_density distinct near_second second_density capitals "
    "shouted exclaimed punctuation obfuscated obfuscated_hits stretched"
).split()

_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(r"\b[^\W\d_]+[0-9@$!*._-]+[^\W\d_][\w@$!*._-]*")
_STRETCH = re.compile(r"([^\W\d_])\1\1")


def keys(word: str) -> list[str]:
    """What may stand in a lexicon for a lower-cased word: itself, and beginnings marked by *."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Lexicon:
    """Log-odds by entry; `of` is a word's strongest entry, or zero."""

    entries: dict[str, float]

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def of(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[word] = max((self.entries.get(k, 0.0) for k in keys(word)), default=0.0)
        return found


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The values of NAMES. A null or empty text has zeros."""
    if not text:
        return [0.0] * len(NAMES)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, lower = int(raw[65:91].sum()), int(raw[97:123].sum())
    marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    of = lexicon.of
    weights = np.fromiter(map(of, words), np.float64, len(words))
    at = np.flatnonzero(weights >= HIT_ODDS)
    weak = int((weights > 0).sum()) - len(at)
    second = [i for i, w in enumerate(words) if w in _SECOND]
    near = 0
    if len(at) and second:
        place = np.searchsorted(second, at)
        left = at - np.array([-10, *second])[place]
        right = np.array([*second, len(words) + 10])[place] - at
        near = int((np.minimum(left, right) <= 3).sum())
    odd = _ODD.findall(text)
    plain = [re.sub(r"[\W\d_]", "", w.lower().translate(LOOKALIKES)) for w in odd]
    return [
        math.log1p(len(words)),
        100.0 * sum(w in _INSULTS for w in words) / n,
        float(len(at)),
        100.0 * len(at) / n,
        float(weights.max(initial=0.0)),
        float(weights.sum()) / math.sqrt(n),
        float(weak),
        100.0 * weak / n,
        float(len({words[i] for i in at.tolist()})),
        float(near),
        100.0 * len(second) / n,
        upper / max(1, upper + lower),
        sum(map(str.isupper, text.split())) / n,
        100.0 * int(raw[33]) / n,
        marks / len(text),
        100.0 * len(odd) / n,
        float(sum(w in _INSULTS or of(w) >= HIT_ODDS for w in plain)),
        100.0 * len(_STRETCH.findall(text)) / n,
    ]


_SECOND, _INSULTS = frozenset(SECOND), frozenset(INSULTS)


def held_out(id_col: str, of: int = 4, remainder: int = 2) -> Column:
    """Whether crc32 of the id, as text, leaves that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == remainder, F.lit(False))


def _counts(texts: DataFrame, wanted: dict[int, frozenset[str]] | None = None) -> DataFrame:
    """(fold, key, n): rows of (fold, text) by the keys of their words, each key once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()  # of the bounded sample's rows in this task
        for batch in portions(batches, "text"):
            for fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {k for w in set(_WORD.findall(text.lower())) for k in keys(w)}
                found.update((fold, k) for k in (own if wanted is None else own & wanted[fold]))
        folds, names = pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.string())
        yield pa.RecordBatch.from_arrays([folds, names, pa.array(list(found.values()), pa.int64())], ["fold", "key", "n"])

    return mapped(texts, run, "fold int, key string, n long").groupBy("fold", "key").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, size: int = LEXICON) -> dict[int, Lexicon]:
    """Lexicons from rows (fold 0 or 1, text, label): 0 and 1 are learned from the *other*
    fold's rows, 2 from all. Candidates, and so what reaches the driver, are bounded."""
    totals = Counter()
    for r in rows.groupBy("fold", "label").count().collect():
        totals[r["fold"], r["label"]] += r["count"]
    toxic = _counts(rows.filter("label = 1").select("fold", "text")).filter(F.col("n") >= LEAST_ROWS // 2)
    best = toxic.orderBy(F.col("n").desc(), "key", "fold").limit(100 * size).collect()
    ones = {(r["fold"], r["key"]): r["n"] for r in best}
    wanted = frozenset(k for _, k in ones)
    clean = _counts(rows.filter("label = 0").select("fold", "text"), {0: wanted, 1: wanted}) if wanted else None
    zeros = {(r["fold"], r["key"]): r["n"] for r in clean.collect()} if wanted else {}
    out = {}
    for fold, taken in ((0, (1,)), (1, (0,)), (2, (0, 1))):
        n1, n0 = (sum(totals[f, label] for f in taken) for label in (1, 0))
        odds = {}
        for k in wanted:
            a, b = (sum(x.get((f, k), 0) for f in taken) for x in (ones, zeros))
            if a >= LEAST_ROWS:
                w = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
                if w >= LEAST_ODDS:
                    odds[k] = a, w
        first = sorted(odds, key=lambda k: (-odds[k][0] * odds[k][1], k))[:size]
        out[fold] = Lexicon({k: odds[k][1] for k in first} | {w: max(HIT_ODDS, odds.get(w, (0, 0))[1]) for w in INSULTS})
    return out


def _featured(rows: DataFrame, lexicons: dict[int, Lexicon]) -> DataFrame:
    """`rows` (with fold and text) with `x`, the features by the lexicon of the row's fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            names = batch.schema.names
            texts, folds = batch.column("text").to_pylist(), batch.column("fold").to_pylist()
            x = [features(t, lexicons[f]) for t, f in zip(texts, folds)]
            kept = [n for n in names if n not in ("text", "fold")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(x, pa.list_(pa.float64()))], [*kept, "x"])

    kept = [f for f in rows.schema if f.name not in ("text", "fold")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "x array<double>"])
    return mapped(rows, run, schema)


class Scorer:
    """A fitted lexicon, trees and calibration; without both labels, their mean alone."""

    def __init__(self, lexicon: Lexicon, trees=None, calibration=None, mean: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.mean = lexicon, trees, calibration, mean

    def scores(self, docs: DataFrame, *, text_col: str = "text", keep: list[str]) -> DataFrame:
        """The columns `keep` and `score`, one row per row of `docs`. A null text is an empty one."""
        return self._scored(docs, text_col, keep).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "score")

    def below(self, docs: DataFrame, threshold: float, *, text_col: str = "text") -> DataFrame:
        """The rows of `docs` that score below the threshold, as they are."""
        kept = self._scored(docs, text_col, docs.columns).filter(F.col("score") < threshold)
        return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])

    def _scored(self, docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
        kept = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
        if self.trees is None:
            return docs.select(*kept, F.lit(self.mean).alias("score"))
        rows = docs.select(*kept, F.lit(2).alias("fold"), F.col(text_col).cast("string").alias("text"))
        return self._calibrated(_featured(rows, {2: self.lexicon}))

    def _calibrated(self, featured: DataFrame) -> DataFrame:
        raw = self.trees.transform(featured.withColumn("features", array_to_vector("x")))
        raw = raw.withColumn("p", vector_to_array("probability")[1]).drop("features", "probability", "rawPrediction", "prediction")
        if self.calibration is None:
            return raw.withColumn("score", F.col("p"))
        return self.calibration.transform(raw).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    rounds: int = 20,
    depth: int = 3,
) -> Scorer:
    """Fit on at most `sample` labelled rows that are not held out, first by hash of the id.

    An id labelled twice takes the larger label; null ids, labels and texts are left out.
    """
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter("id IS NOT NULL AND label IN (0, 1)")
        .filter(~held_out("id"))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    marked = hashed_sample(marked, ["id"], sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    # At most `sample` ids, so texts of other rows never move. Equal texts go to one fold.
    rows = texts.join(F.broadcast(marked), "id").withColumn("h", F.xxhash64("text"))
    rows = rows.withColumns({"fold": F.pmod("h", F.lit(2)).cast("int"), "part": F.pmod(F.shiftright("h", 8), F.lit(4)).cast("int")})
    rows = staged(rows.drop("id", "h"), "toxicity_rows")
    found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    lexicons = learn(rows)
    if len(found) < 2:
        return Scorer(lexicons[2], mean=float(found.get(1, 0) > 0))
    table = staged(_featured(rows, lexicons), "toxicity_features")
    if table.filter("part > 0").select("label").distinct().count() < 2:
        return Scorer(lexicons[2], mean=found[1] / sum(found.values()))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64)
    model = trees.fit(table.filter("part > 0").select("label", array_to_vector("x").alias("features")))
    scorer = Scorer(lexicons[2], model)
    rest = table.filter("part = 0")
    if rest.select("label").distinct().count() == 2:
        isotonic = IsotonicRegression(labelCol="label", featuresCol="p", predictionCol="prediction")
        scorer.calibration = isotonic.fit(scorer._calibrated(rest).select(F.col("label").cast("double"), "p"))
    return scorer


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """(id, held_out, score, predicted): one row per row of `docs`, whatever its text or id."""
    scored = fit(docs, labels, id_col=id_col, **options).scores(docs, keep=[id_col], text_col=options.get("text_col", "text"))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """`docs` without rows that score at or above the threshold."""
    return fit(docs, labels, text_col=text_col, **options).below(docs, threshold, text_col=text_col)
