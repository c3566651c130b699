"""SimHash near-duplicates: fingerprints, and a binary trie joined with itself.

Texts become 64-bit fingerprints; equal fingerprints collapse to one node. Fingerprints are
leaves of a binary trie, and the join walks pairs of trie nodes together, adding up differing
bits and dropping a pair once it is over budget. With budget b the bits are cut into b + 1
blocks. Two fingerprints within the budget agree in one block exactly, so the trie is laid out
once per block with that block first, and each walk starts at pairs (node, node) below it. A
node with many leaves is opened by Spark a few bits at a time, pair by pair, until every
remaining pair is small; those are spread over the tasks and walked to the end there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from .components import components
from .tables import mapped, portions

#: XXH64 seed of the shingle hashes.
SEED = 42
#: Leaves under a pair of nodes that one task walks; larger pairs are opened first.
LEAF = 4096
#: Trie levels that one round of opening descends.
STEP = 6


def fingerprint(words: list[bytes], width: int) -> int:
    """Bit i is set if it is set in more than half of the shingle hashes; no words: zero."""
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(text, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-width] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): one row per input row. A-Z is lowered, words are cut at ASCII white space.

    A null text counts as empty; a text of no words gets zero, one of fewer words than a
    shingle is hashed as a whole. Whatever other columns there are take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            found = [
                fingerprint(text.lower().split(), words) if text else 0
                for text in batch.column(1).cast(pa.binary()).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, "id long, fp long")


def _rotated(fps: DataFrame, shifts: list[int]) -> DataFrame:
    """(rot, key) for each block: the fingerprint turned left so that the block leads."""
    fp = F.col("fp")
    turned = [
        F.struct(
            F.lit(r).alias("rot"),
            (fp if not s else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, 64 - s))).alias("key"),
        )
        for r, s in enumerate(shifts)
    ]
    return fps.select(F.inline(F.array(*turned)))


def _walk(keys: np.ndarray, roots: dict[int, list[np.ndarray]], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of `keys` within `budget` bits, below the given pairs of trie nodes.

    A node is a range of `keys` sharing a prefix, in order. `roots` has, by depth, arrays
    (lo, hi, lo', hi', bits so far); a node paired with itself has equal ranges.
    """
    none = np.zeros((5, 0), np.int64)
    live, left, right = none, [], []
    for depth in range(min(roots, default=64), 64):
        live = np.concatenate([live, *(r for r in roots.get(depth, []))], axis=1)
        a, b, c, d, bits = live
        single = (b - a == 1) & (d - c == 1)
        if single.any():
            done = single & (a != c)
            near = np.bitwise_count(keys[a[done]] ^ keys[c[done]]) <= budget
            left.append(a[done][near])
            right.append(c[done][near])
            live = live[:, ~single]
            a, b, c, d, bits = live
        if not live.shape[1]:
            continue
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        m, n = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = a == c
        opened = [(a, m, c, n, bits), (m, b, n, d, bits), (a, m, n, d, bits + 1), (m, b, c, n, bits + 1)]
        drop = [None, None, None, same]  # of a node with itself, (left, right) is (right, left)
        kept = []
        for (p, q, r, s, e), without in zip(opened, drop):
            keep = (q > p) & (s > r) & (e <= budget)
            kept.append(np.stack([p, q, r, s, e])[:, keep if without is None else keep & ~without])
        live = np.concatenate(kept, axis=1)
    a, _, c, _, _ = np.concatenate([live, *roots.get(64, [])], axis=1)
    left.append(a[a != c])
    right.append(c[a != c])
    return np.concatenate(left), np.concatenate(right)


def _units(unit: np.ndarray, side: np.ndarray, depth: np.ndarray, bits: np.ndarray) -> dict[int, list[np.ndarray]]:
    """The roots of `_walk` for rows in order of (unit, side, key); unit holds 0, 1, ..."""
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    last = np.r_[first[1:], len(unit)]
    ones = np.r_[0, np.cumsum(side)]
    middle = last - (ones[last] - ones[first])
    paired = middle < last
    roots = np.stack(
        [first, np.where(paired, middle, last), np.where(paired, middle, first), last, bits[first]]
    ).astype(np.int64)
    at = depth[first]
    return {int(t): [roots[:, at == t]] for t in np.unique(at)}


def _walked(shifts: list[int], budget: int):
    """The map over rows (rot, depth, u, v, bits, side, key), sorted so: links (a, b)."""
    sizes = np.diff([*shifts, 64])

    def links(table: pa.Table) -> pa.RecordBatch:
        cols = {n: table.column(n).to_numpy() for n in ("rot", "depth", "u", "v", "bits", "side", "key")}
        change = np.zeros(len(cols["u"]), bool)
        for n in ("rot", "depth", "u", "v"):
            change[1:] |= cols[n][1:] != cols[n][:-1]
        keys = cols["key"].view(np.uint64)
        roots = _units(np.cumsum(change), cols["side"].astype(np.int64), cols["depth"], cols["bits"])
        i, j = _walk(keys, roots, budget)
        turn = np.array(shifts, np.uint64)[cols["rot"][i]]
        back = lambda k: np.where(turn == 0, k, (k >> turn) | (k << ((np.uint64(64) - turn) % np.uint64(64))))
        a, b = back(keys[i]), back(keys[j])
        first = np.full(len(a), len(shifts))
        for r in reversed(range(len(shifts))):
            block = ((a ^ b) << np.uint64(shifts[r])) >> np.uint64(64 - sizes[r])
            first = np.where(block == 0, r, first)
        own = first == cols["rot"][i]  # each link once: from the first block that agrees
        pair = [x[own].view(np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(*pair)), pa.array(np.maximum(*pair))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows of the last unit wait for those that the next batch may hold.
            edge = np.zeros(batch.num_rows, bool)
            for n in ("rot", "depth", "u", "v"):
                x = batch.column(n).to_numpy()
                edge[1:] |= x[1:] != x[:-1]
                if rest and rest[-1].column(n)[-1].as_py() != x[0]:
                    edge[0] = True
            starts = np.flatnonzero(edge)
            if len(starts):
                cut = int(starts[-1])
                whole = [*rest, batch.slice(0, cut)] if cut else rest
                if sum(x.num_rows for x in whole):
                    yield links(pa.Table.from_batches(whole).combine_chunks())
                rest = [batch.slice(cut)]
            else:
                rest.append(batch)
        if rest:
            yield links(pa.Table.from_batches(rest).combine_chunks())

    return run


def trie_links(fps: DataFrame, *, budget: int = 2, leaf: int = LEAF, step: int = STEP) -> DataFrame:
    """Links (a, b), a < b, once each, between distinct fingerprints `fp` that differ in at
    most `budget` bits. `fps` must hold each fingerprint once."""
    if not 0 <= budget <= 7:
        raise ValueError(f"budget must be from 0 to 7, got {budget}")
    width, more = divmod(64, budget + 1)
    sizes = [width + (r < more) for r in range(budget + 1)]
    shifts = [sum(sizes[:r]) for r in range(budget + 1)]
    start = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("rot") + 1)
    zero = F.lit(0).cast("long")
    items = _rotated(fps, shifts).withColumn("depth", start).withColumn("u", _prefix(F.col("depth")))
    sized = items.groupBy("rot", "u").agg(F.count("*").alias("n")).filter("n > 1")
    kept = staged(items.join(sized, ["rot", "u"]), "trie")
    whole = kept.filter(F.col("n") <= leaf).select(
        "rot", "depth", "u", F.col("u").alias("v"), zero.alias("bits"), zero.alias("side"), "key"
    )
    large = kept.filter(F.col("n") > leaf).select("rot", "key")
    pairs = (
        kept.filter(F.col("n") > leaf)
        .select("rot", "depth", "u", F.col("u").alias("v"), zero.alias("bits"))
        .distinct()
    )
    k = 0
    while not pairs.isEmpty():
        depths = F.least(F.lit(64), start + step * k), F.least(F.lit(64), start + step * (k + 1))
        pairs, ready = _opened(large, pairs, depths, budget=budget, leaf=leaf)
        own, other = (F.struct(F.col(n).alias("node"), F.lit(i).cast("long").alias("side")) for i, n in enumerate("uv"))
        sides = F.when(F.col("u") == F.col("v"), F.array(own)).otherwise(F.array(own, other))
        below = large.withColumn("depth", depths[1]).withColumn("node", _prefix(F.col("depth")))
        whole = whole.unionByName(
            below.join(ready.select("*", F.inline(sides)), ["rot", "depth", "node"]).drop("node")
        )
        k += 1
    unit = ["rot", "depth", "u", "v"]
    ordered = whole.repartition(*unit).sortWithinPartitions(*unit, "side", _unsigned("key"))
    return mapped(ordered, _walked(shifts, budget), "a long, b long")


def _unsigned(name: str) -> Column:
    """An order in which a long's bits count as an unsigned number."""
    return F.col(name).bitwiseXOR(F.lit(-(2**63)).cast("long"))


def _prefix(depth: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.col("key"), (F.lit(64) - depth).cast("int"))


def _opened(
    items: DataFrame, pairs: DataFrame, depths: tuple[Column, Column], *, budget: int, leaf: int
) -> tuple[DataFrame, DataFrame]:
    """One round down the trie, from one depth to the next: (pairs still too large, pairs to
    walk). A node has few nodes below it, so a pair opens into a bounded number of pairs."""
    at, down = depths
    nodes = pairs.select("rot", F.explode(F.array("u", "v")).alias("up")).distinct()
    below = (
        items.withColumn("up", _prefix(at))
        .join(nodes, ["rot", "up"])
        .groupBy("rot", "up", _prefix(down).alias("node"))
        .agg(F.count("*").alias("n"))
    )
    one = below.select("rot", F.col("up").alias("u"), F.col("node").alias("nu"), F.col("n").alias("n1"))
    two = below.select("rot", F.col("up").alias("v"), F.col("node").alias("nv"), F.col("n").alias("n2"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), (down - at).cast("int")) - 1
    found = (
        pairs.join(one, ["rot", "u"])
        .join(two, ["rot", "v"])
        .filter((F.col("u") != F.col("v")) | (F.col("nu") <= F.col("nv")))
        .withColumn("bits", F.col("bits") + F.bit_count(F.col("nu").bitwiseXOR(F.col("nv")).bitwiseAND(low)))
        .filter(F.col("bits") <= budget)
        .filter((F.col("nu") != F.col("nv")) | (F.col("n1") > 1))
        .select("rot", down.alias("depth"), F.col("nu").alias("u"), F.col("nv").alias("v"), "bits", "n1", "n2")
    )
    found = staged(found, "trie_pairs")
    small = (F.col("n1") + F.col("n2") <= leaf) | (F.col("depth") == 64)
    return found.filter(~small).drop("n1", "n2"), found.filter(small).drop("n1", "n2")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2
) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links): one row per input row.

    `component_id` is the smallest id reachable over links, the row's own included, and
    `n_links` counts other fingerprints within the budget. Rows with equal fingerprints are
    always linked, so copies never become pairs. Null ids never name a component: a component
    of null ids alone has a null id. Ids are whole numbers: they are cast to long, and where a
    string is none the cast fails the query (ANSI mode) or gives a null id. Empty tables give no
    rows.
    """
    marks = staged(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    nodes = staged(marks.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    links = staged(trie_links(nodes.select("fp"), budget=budget), "links")
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    rooted = (
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .join(degree, "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    classes = named.select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return marks.join(classes, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "n_links",
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each component, that with the smallest id; of rows repeated under
    one id and text, one. Rows with a null id stay: nothing else names them."""
    named = docs.filter(F.col(id_col).isNotNull())
    found = near_duplicates(named, id_col=id_col, text_col=text_col, **options)
    return keep_least(docs, found, id_col=id_col, text_col=text_col)


def keep_least(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id names its component in `found` (doc_id, component_id), each id
    and text once, and those with a null id."""
    named = docs.filter(F.col(id_col).isNotNull())
    kept = staged(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    # About as many ids stay as there are documents, so this is a shuffle join at any size: a
    # broadcast of few ids would only make small runs unlike large ones.
    ids = kept.select(F.col("doc_id").alias(id_col)).hint("merge")
    out = named.join(ids, id_col, "left_semi")
    if not kept.filter("n > 1").isEmpty():
        out = out.dropDuplicates([id_col, text_col])
    return out.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
