"""Boosted trees grown leaf by leaf over distributed histograms.

Feature values are cut into bins once; missing values have a bin of their own. A tree grows best
first: of all leaves, the one whose best split gains most is split next, until there are enough.
What a split gains follows from a histogram, the sums of gradient and curvature per (leaf, feature,
bin). Each task adds up its own rows and only those sums reach the driver. Growth goes on past
leaves whose histogram is not there yet, all of these are asked for together, and the order is
gone through again with what they show: a tree costs about as many jobs as it has levels. Several
forests, of other numbers of leaves, grow in the same jobs.

A split sends missing values to whichever side gains more. Boosting adds trees to a chain, so the
first 100 trees of 300 are the forest of 100 rounds: `scored` reads any prefix.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.stage import staged
from .features import design

# Functions that run in tasks are sent with the job: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The described learner's rate and least curvature of a leaf.
RATE = 0.05
LEAST_CURVATURE = 1e-3
#: Bins of a feature besides that of missing values, and rounds between written scores.
BINS = 254
WRITTEN = 25
#: Rows that make a partition worth a task of its own.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class Node:
    """A leaf, or a split: bins up to `bin` go left, and missing values if `missing_left`."""

    value: float = 0.0
    feature: int = -1
    bin: int = 0
    missing_left: bool = False
    left: int = 0
    right: int = 0


@dataclass(frozen=True)
class Split:
    gain: float
    node: Node
    values: tuple[float, float]


@dataclass(frozen=True)
class Forest:
    """`start` is the score before the first tree; edges[f] are the upper ends of f's bins."""

    columns: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    start: float
    trees: tuple[tuple[Node, ...], ...] = ()

    def prefix(self, rounds: int) -> Forest:
        return replace(self, trees=self.trees[:rounds])


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> tuple[tuple[float, ...], ...]:
    """Upper ends of each feature's bins but the last: midway between values where these are few,
    else approximate quantiles."""
    known = design(df, columns, impute=False)
    counts = known.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    shares = [i / bins for i in range(1, bins)]
    few = {c for c in columns if counts[c] <= bins // 2}
    found = known.agg(
        *[(F.array_sort(F.collect_set(c)) if c in few else F.percentile_approx(c, shares, 20 * bins)).alias(c) for c in columns]
    ).first()
    edges = []
    for c in columns:
        values = found[c] or []
        edges.append(tuple((x + y) / 2 for x, y in zip(values, values[1:])) if c in few else tuple(sorted(set(values))))
    return tuple(edges)


def binned(matrix: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bins from 1, 0 for missing; a value equal to an edge belongs to the bin below it."""
    out = np.zeros(matrix.shape, np.int16)
    for f, ends in enumerate(edges):
        known = ~np.isnan(matrix[:, f])
        out[known, f] = 1 + np.searchsorted(np.asarray(ends, float), matrix[known, f], "left")
    return out


def leaf_of(tree: Sequence[Node], bins: np.ndarray) -> np.ndarray:
    """The node that each row ends in."""
    at = np.zeros(len(bins), np.int64)
    for i, node in enumerate(tree):  # children come after their parent
        if node.feature >= 0:
            here = np.flatnonzero(at == i)
            own = bins[here, node.feature]
            at[here] = np.where(np.where(own == 0, node.missing_left, own <= node.bin), node.left, node.right)
    return at


def _value(side: np.ndarray) -> float:
    return float(-RATE * side[0] / side[1]) if side[1] else 0.0


def best_split(sums: np.ndarray, least: int) -> Split | None:
    """The split of a node that gains most, from its sums [feature, bin, (gradient, curvature,
    rows)]; ties to the first feature, the first bin and missing values on the right. None if no
    split gains anything and leaves `least` rows on both sides."""
    whole = sums[0].sum(axis=0)
    upto = np.cumsum(sums[:, 1:, :], axis=1)[:, :-1]
    sides = np.stack([upto, upto + sums[:, :1, :]])  # missing values right, left
    rest = whole - sides
    ok = np.ones(sides.shape[:3], bool)
    for part in (sides, rest):
        ok &= (part[..., 2] >= least) & (part[..., 1] >= LEAST_CURVATURE)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sides[..., 0] ** 2 / sides[..., 1] + rest[..., 0] ** 2 / rest[..., 1] - whole[0] ** 2 / whole[1]
    gain = np.where(ok, gain, -np.inf).transpose(1, 2, 0)  # feature, bin, side of the missing
    top = float(gain.max())
    if top <= 1e-12:
        return None
    f, b, m = np.unravel_index(int(np.argmax(gain >= top * (1 - 1e-12))), gain.shape)
    return Split(top, Node(feature=int(f), bin=int(b) + 1, missing_left=bool(m)), (_value(sides[m, f, b]), _value(rest[m, f, b])))


@dataclass
class Growth:
    """A tree under way. Nodes are named 1, and 2k and 2k + 1 below k; `known` has the best split
    of each node whose histogram was seen, None if it has none."""

    leaves: int
    least: int
    known: dict[int, Split | None] = field(default_factory=dict)
    root: float = 0.0

    def see(self, name: int, sums: np.ndarray) -> None:
        if name == 1:
            self.root = _value(sums[0].sum(axis=0))
        self.known[name] = best_split(sums, self.least)

    def grown(self) -> tuple[list[Node], dict[int, int]]:
        """(nodes, places by name of leaves that must be seen): the tree, best first as far as it
        is known. Nothing is left to be seen once no unseen leaf could have come first."""
        nodes, leaves, blind = [Node(self.root)], {1: 0}, False
        while len(leaves) < self.leaves:
            unseen = any(k not in self.known for k in leaves)
            open_ = [k for k in leaves if self.known.get(k)]
            blind |= unseen
            if not open_:
                break
            name = max(open_, key=lambda k: (self.known[k].gain, -k))
            split, at = self.known[name], leaves.pop(name)
            nodes[at] = replace(split.node, value=nodes[at].value, left=len(nodes), right=len(nodes) + 1)
            for side in (0, 1):
                leaves[2 * name + side] = len(nodes)
                nodes.append(Node(split.values[side]))
        return nodes, {k: at for k, at in leaves.items() if blind and k not in self.known}


def histogram(bins: np.ndarray, slot: np.ndarray, slots: int, grad: np.ndarray, curve: np.ndarray, width: int) -> np.ndarray:
    """[slot, feature, bin, (gradient, curvature, rows)] of the rows whose slot is not negative."""
    some = slot >= 0
    bins, slot, grad, curve = bins[some], slot[some], grad[some], curve[some]
    out = np.zeros((slots, bins.shape[1], width, 3))
    for f in range(bins.shape[1]):
        at = slot * width + bins[:, f]
        for k, weight in enumerate((grad, curve, None)):
            out[:, f, :, k] = np.bincount(at, weight, slots * width).reshape(slots, width)
    return out


def _matrix(batch: pa.RecordBatch, features: int) -> np.ndarray:
    """The bins of a batch, whose first column is an array of them."""
    return batch.column(0).flatten().to_numpy().reshape(batch.num_rows, features)


def _advanced(score: np.ndarray, trees: Sequence[Sequence[Node]], bins: np.ndarray) -> np.ndarray:
    for tree in trees:
        score = score + np.array([n.value for n in tree])[leaf_of(tree, bins)]
    return score


def _seen(data: DataFrame, chains: list[list], growths: list[Growth], width: int, features: int) -> bool:
    """Shows each growth the histograms that it has to see, by one job; False if there are none."""
    shapes, wanted = zip(*[g.grown() for g in growths])
    if not any(wanted):
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(w), features, width, 3)) for w in wanted]
        for batch in batches:
            bins, y = _matrix(batch, features), batch.column(1).to_numpy()
            for c, chain in enumerate(chains):
                if wanted[c]:
                    p = 1 / (1 + np.exp(-_advanced(batch.column(2 + c).to_numpy(), chain, bins)))
                    slots = np.full(len(shapes[c]), -1)
                    slots[list(wanted[c].values())] = np.arange(len(wanted[c]))
                    total[c] += histogram(bins, slots[leaf_of(shapes[c], bins)], len(wanted[c]), p - y, p * (1 - p), width)
        names = [(c, k) for c, w in enumerate(wanted) for k in range(len(w))]
        columns = [pa.array([x[i] for x in names], pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([total[c][k].tobytes() for c, k in names], pa.binary())], ["chain", "slot", "sums"])

    sums: dict[tuple[int, int], np.ndarray] = {}
    for c, k, raw in zip(*[x.to_pylist() for x in data.mapInArrow(run, "chain int, slot int, sums binary").toArrow().columns]):
        part = np.frombuffer(raw).reshape(features, width, 3)
        sums[c, k] = sums[c, k] + part if (c, k) in sums else part
    for c, names in enumerate(wanted):
        for k, name in enumerate(names):
            growths[c].see(name, sums.get((c, k), np.zeros((features, width, 3))))
    return True


def fit_forests(
    df: DataFrame, columns: Sequence[str], y: str, *, leaves: Sequence[int], rounds: int, least: int, bins: int = BINS
) -> list[Forest]:
    """One forest per number of `leaves`, of `rounds` trees each, on rows with a 0/1 `y`.

    Missing values are nulls or NaN. `least` is the fewest rows of a leaf; a tree that cannot split
    is one leaf. The driver holds edges, trees and the histograms of one level.
    """
    columns = tuple(columns)
    edges = bin_edges(df, columns, bins)
    width = max(2, *(len(e) + 2 for e in edges))
    shape = df.agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("rate")).first()
    rate = min(max(shape["rate"] or 0.0, 1e-6), 1 - 1e-6)
    start = math.log(rate / (1 - rate))
    names = [f"score{c}" for c in range(len(leaves))]
    kinds = "bins array<short>, y double, " + ", ".join(f"{n} double" for n in names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(columns))
            found = pa.ListArray.from_arrays(ends, pa.array(binned(_values(batch, len(columns)), edges).ravel()))
            scores = [pa.array(np.full(batch.num_rows, start)) for _ in leaves]
            yield pa.RecordBatch.from_arrays([found, batch.column(len(columns)), *scores], ["bins", "y", *names])

    tasks = max(1, math.ceil(shape["n"] / TASK_ROWS))
    rows = design(df.withColumn("_y", F.col(y).cast("double")), columns, keep=["_y"], impute=False).select(*columns, "_y")
    data = staged(rows.mapInArrow(cut, kinds).repartition(tasks), "forest_rows").coalesce(tasks).persist()
    forests: list[list[tuple[Node, ...]]] = [[] for _ in leaves]
    late: list[list[tuple[Node, ...]]] = [[] for _ in leaves]  # trees that the written scores lack

    def step(batches: Iterator[pa.RecordBatch], late: list = late) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [pa.array(_advanced(batch.column(2 + c).to_numpy(), chain, _matrix(batch, len(columns)))) for c, chain in enumerate(late)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *scores], ["bins", "y", *names])

    for done in range(1, rounds + 1):
        growths = [Growth(n, least) for n in leaves]
        while _seen(data, late, growths, width, len(columns)):
            pass
        for forest, chain, growth in zip(forests, late, growths):
            tree = tuple(growth.grown()[0])
            forest.append(tree)
            chain.append(tree)
        if done % WRITTEN == 0 and done < rounds:
            before, data = data, staged(data.mapInArrow(step, kinds), "forest_scores").coalesce(tasks).persist()
            before.unpersist()
            for chain in late:
                chain.clear()
    data.unpersist()
    return [Forest(columns, edges, start, tuple(trees)) for trees in forests]


def _values(batch: pa.RecordBatch, features: int) -> np.ndarray:
    """The first columns of a batch as a matrix, NaN where they are null."""
    columns = [batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(features)]
    return np.column_stack(columns) if columns else np.zeros((batch.num_rows, 0))


def scored(df: DataFrame, forests: dict[str, Forest], keep: Sequence[str]) -> DataFrame:
    """`keep` and a column of raw scores per forest, all of them in one pass. Forests may be
    prefixes of each other, but share columns and edges."""
    some = next(iter(forests.values()))
    columns, edges = some.columns, some.edges
    plain = design(df, columns, impute=False, keep=[F.col(c).alias(f"_keep_{c}") for c in keep])
    plain = plain.select(*columns, *[f"_keep_{c}" for c in keep])
    kept = [StructField(c, plain.schema[f"_keep_{c}"].dataType) for c in keep]
    schema = StructType([*kept, *[StructField(n, DoubleType()) for n in forests]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(_values(batch, len(columns)), edges)
            found, done = [], {}
            for forest in forests.values():
                # The longest chain already summed that this one goes on from.
                starts = [(n, s) for (trees, n), s in done.items() if n <= len(forest.trees) and forest.trees[:n] == trees]
                n, score = max(starts, key=lambda x: x[0], default=(0, np.full(batch.num_rows, forest.start)))
                score = _advanced(score, forest.trees[n:], bins)
                done[forest.trees, len(forest.trees)] = score
                found.append(pa.array(score))
            yield pa.RecordBatch.from_arrays([*batch.columns[len(columns) :], *found], [f.name for f in schema.fields])

    return plain.mapInArrow(run, schema)
