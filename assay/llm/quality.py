"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own and those of its neighbours; a line's label
also depends on the label before it. The field is fitted on lines of labelled documents, each
line taking its document's label. A document's score is the share of its characters that stand
in good lines, by the forward-backward marginals.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from .tables import hashed_sample, mapped, portions
from .toxicity import held_out

#: Most labelled documents to fit on, first by hash of their id; and most of their lines.
SAMPLE = 4000
SAMPLE_LINES = 200_000
THRESHOLD = 0.3
ROUNDS = 80

# Classes of bytes that features count.
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[*range(97, 123)]] = 1
_CLASSES[[*range(65, 91)]] = 2
_CLASSES[[*range(48, 58)]] = 3
_CLASSES[[32, 9, 11, 12, 13]] = 4
_CLASSES[[ord(c) for c in ".,;:'\"!?()-"]] = 5
_CLASSES[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASSES[128:] = 7
OWN = 19
#: Own features, the neighbours' features, and a constant.
WIDTH = 3 * OWN + 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines of a text; a null or empty text has one empty line."""
    data = (text or "").encode()
    lines = data.split(b"\n")
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    classes = _CLASSES[np.frombuffer(data + b"\n", np.uint8)]
    counts = np.stack([np.add.reduceat(classes == k, starts, dtype=np.int64) for k in range(1, 8)], axis=1)
    size = np.maximum(lengths, 1)[:, None]
    words = [line.split() for line in lines]
    n = np.fromiter(map(len, words), np.float64, len(words))
    kinds = np.fromiter((len(set(w)) for w in words), np.float64, len(words))
    runs = np.fromiter((sum(a == b for a, b in zip(w, w[1:])) for w in words), np.float64, len(words))
    seen = Counter(lines)
    again = np.fromiter((seen[line] > 1 and len(line) > 0 for line in lines), np.float64, len(lines))
    ends = np.fromiter((line[-1:] in (b".", b"!", b"?") for line in lines), np.float64, len(lines))
    per = np.maximum(n, 1)
    own = np.column_stack(
        [
            counts / size,
            np.log1p(lengths) / 8,
            np.log1p(n) / 6,
            kinds / per,
            runs / per,
            lengths / per / 16,
            again,
            ends,
            lengths == 0,
            np.minimum(1, counts[:, 5] / per),
            counts[:, 1] > counts[:, 0],
            kinds / per < 0.5,
            np.full(len(lines), math.log1p(len(lines)) / 6),
        ]
    ).astype(np.float64)
    edge = np.zeros((1, OWN))
    return np.column_stack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones(len(lines))]), lengths


@dataclass(frozen=True)
class Field:
    """Weights of the features for good over bad, and of a label after the one before it."""

    weights: np.ndarray
    links: tuple[tuple[float, float], tuple[float, float]]


def marginals(potentials: list[float], links: tuple) -> tuple[list[float], list[list[float]], float]:
    """(share of good per line, expected label pairs, log of the normaliser) of one chain.

    `potentials` are log-odds of good by the line alone.
    """
    (e00, e01), (e10, e11) = ((math.exp(x) for x in row) for row in links)
    ahead, scale, total = [], [], 0.0
    a0 = a1 = 0.5
    first = True
    odds = [math.exp(max(-30.0, min(30.0, p))) for p in potentials]
    for o in odds:
        b0, b1 = (1.0, o) if first else (a0 * e00 + a1 * e10, (a0 * e01 + a1 * e11) * o)
        first = False
        z = b0 + b1
        a0, a1 = b0 / z, b1 / z
        total += math.log(z)
        ahead.append((a0, a1))
        scale.append(z)
    good = [0.0] * len(odds)
    pairs = [[0.0, 0.0], [0.0, 0.0]]
    r0 = r1 = 1.0
    for t in range(len(odds) - 1, -1, -1):
        a0, a1 = ahead[t]
        good[t] = a1 * r1 / (a0 * r0 + a1 * r1)
        if t:
            p0, p1 = ahead[t - 1]
            z, o1 = scale[t], odds[t] * r1
            pairs[0][0] += p0 * e00 * r0 / z
            pairs[0][1] += p0 * e01 * o1 / z
            pairs[1][0] += p1 * e10 * r0 / z
            pairs[1][1] += p1 * e11 * o1 / z
            r0, r1 = (e00 * r0 + e01 * o1) / z, (e10 * r0 + e11 * o1) / z
    return good, pairs, total


def fit_field(chains: list[np.ndarray], labels: list[int], rounds: int = ROUNDS, ridge: float = 1e-3) -> Field:
    """The weights of the highest likelihood, by gradient steps with momentum and own rates.

    Each chain counts the same in all, whatever its number of lines.
    """
    x = np.concatenate(chains)
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in chains])])
    share = np.concatenate([np.full(len(c), 1 / len(c)) for c in chains]) / len(chains)
    good = np.concatenate([np.full(len(c), float(y)) for c, y in zip(chains, labels)])
    at, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for step in range(1, rounds + 1):
        potentials = (x @ at[:-4]).tolist()
        links = ((at[-4], at[-3]), (at[-2], at[-1]))
        found, pull = np.empty(len(x)), np.zeros(4)
        for i, y in enumerate(labels):
            a, b = bounds[i], bounds[i + 1]
            expected, pairs, _ = marginals(potentials[a:b], links)
            found[a:b] = expected
            seen = np.zeros(4)
            seen[3 * y] = b - a - 1
            pull += (seen - np.ravel(pairs)) / (b - a) / len(labels)
        g = np.concatenate([x.T @ (share * (good - found)), pull]) - ridge * at
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        at = at + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(at[:-4], ((at[-4], at[-3]), (at[-2], at[-1])))


def document_score(text: str | None, field: Field) -> tuple[float, list[float]]:
    """(score, share of good per line); an empty text is as good as its one empty line."""
    x, lengths = line_features(text)
    good, _, _ = marginals((x @ field.weights).tolist(), field.links)
    total = int(lengths.sum())
    score = float(np.dot(lengths, good) / total) if total else good[0]
    return min(1.0, max(0.0, score)), good


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    sample_lines: int = SAMPLE_LINES,
    of: int = 5,
    remainder: int = 0,
) -> Field | float:
    """A field fitted on at most `sample` labelled documents that are not held out, of
    `sample_lines` lines together; without both labels, the mean of those there are (0.5 without
    any). An id labelled twice takes the smaller label; null ids, labels and texts are left out.
    """
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter("id IS NOT NULL AND label IN (0, 1)")
        .filter(~held_out("id", of, remainder))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    marked = hashed_sample(marked, ["id"], sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    # At most `sample` ids, so texts of other rows never move.
    rows = texts.join(F.broadcast(marked), "id").withColumn("h", F.xxhash64("text"))
    rows = rows.select("label", "h", "text", F.size(F.split("text", "\n")).alias("lines"))
    rows = staged(rows, "quality_rows")
    # Equal texts once, so that a group of copies doesn't outweigh the rest.
    each = rows.groupBy("h").agg(F.min("label").alias("label"), F.first("lines").alias("lines")).orderBy("h").collect()
    taken, lines = {}, 0
    for r in each:
        if lines + r["lines"] <= sample_lines:
            taken[r["h"]] = r["label"]
            lines += r["lines"]
    if len(set(taken.values())) < 2:
        return float(np.mean(list(taken.values()))) if taken else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            chains = [line_features(t)[0].astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(chains, pa.binary())], ["h", "x"])

    chains: dict[int, np.ndarray] = {}
    kept = rows.select("h", "text").filter(F.col("h").isin(list(taken))) if len(taken) < len(each) else rows.select("h", "text")
    for r in mapped(kept.dropDuplicates(["h"]), run, "h long, x binary").toLocalIterator():
        chains[r["h"]] = np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH).astype(np.float64)
    order = sorted(chains)
    return fit_field([chains[h] for h in order], [taken[h] for h in order])


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    of: int = 5,
    remainder: int = 0,
    **options,
) -> DataFrame:
    """(id, held_out, score, predicted): one row per row of `docs`, whatever its text or id."""
    field = fit(docs, labels, id_col=id_col, text_col=text_col, of=of, remainder=remainder, **options)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            found = [document_score(t, field)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], [id_col, "score"])

    kind = rows.schema[id_col].dataType.simpleString()
    if isinstance(field, float):
        scored = rows.select(id_col, F.lit(field).alias("score"))
    else:
        scored = mapped(rows, run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, held_out(id_col, of, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def line_labels(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, good): the marginal of every line, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            found = [document_score(t, field)[1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], [id_col, "good"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return mapped(rows, run, f"`{id_col}` {kind}, good array<double>").select(id_col, F.posexplode("good").alias("line", "good"))
