"""Near copies by MinHash with tensored banding, every candidate verified on the whole sets.

Equal sets of word shingles collapse to one node. A node gets two collections of `m` groups of
minhashes; the keys of its m * m tables are all pairs of a group of the first and one of the second,
so some 2 * m * ROWS minhashes do for tables that would take m times as many. Rows are dealt by the
first half of the key alone, and meet in the pairs of halves there, so a node moves m rows.

Nodes that meet in a small bucket are candidates pair by pair. Where many meet, pairs are not
listed: their sets are joined by prefixes instead, rare shingles first, which is exact, and first
with one pivot for each shingle, so that most are linked before pairs across components are asked
for. Candidates are compared on whole sets, made anew from the texts; a text travels once for each
few hundred nodes it is compared with.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import staged
from .components import components
from .simhash import keep_least
from .tables import mapped, portions

#: Words of a shingle, and the similarity of a link as a fraction.
WORDS = 3
NEAR = (17, 20)
#: Minhashes of a group, and how likely a pair just similar enough may share no table.
ROWS = 3
MISS = 2e-5
#: Nodes of a bucket that are paired; more are joined by prefixes.
CROWD = 16
#: Rows of one first half that one task meets; more are dealt by the whole key. Of a table so large
#: that the list of such halves could pass HOT rows for each group, more rows are met.
HALF, HOT = 50_000, 100_000
#: Nodes compared with one copy of a text.
CHUNK = 256
#: Bytes of text hashed at once.
PORTION = 1 << 20


def groups(near: tuple[int, int] = NEAR, rows: int = ROWS, miss: float = MISS) -> int:
    """Groups of each collection: a pair that is just near meets in no table if all groups of one
    or of the other collection differ."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (near[0] / near[1]) ** rows))


def _draw(name: int, size: int) -> np.ndarray:
    """Odd random multipliers."""
    return np.random.Generator(np.random.PCG64(name)).integers(0, 1 << 64, size, np.uint64) | np.uint64(1)


_BYTES, _PLACES = _draw(1, 256), _draw(2, 64)
_BASE = 0x9E3779B97F4A7C1B  # 3 modulo 8, so that places differ in all but their lowest bits
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(size: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64, kept while the task lasts."""
    if size not in _POWERS:
        found = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps))
        _POWERS[size] = found
    return _POWERS[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the shingles of each text, distinct and in order, one text after another.

    A-Z is lowered and words are cut at ASCII white space; a text of fewer words is one shingle,
    one of none, or null, has none. The hash is one of 64 bits of the words of the shingle.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    marks = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lengths = np.diff(marks)
    first, size = int(marks[0]) if len(texts) else 0, int(lengths.sum())
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + size]
    ends = np.cumsum(lengths)
    space = _SPACE[raw]
    before, after = np.r_[True, space[:-1]], np.r_[space[1:], True]
    some = ends[lengths > 0]
    before[some - lengths[lengths > 0]] = True
    after[some - 1] = True
    starts, stops = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    power, inverse = (p[: size + 1] for p in _powers(1 << max(16, (size + 1).bit_length())))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[_LOWER[raw]] * power[:size])]
    word = _mixed((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    owner = np.searchsorted(ends, starts, "right")
    counts = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    # A shingle begins at each word that has enough words behind it, or at the first of a short text.
    left = counts[owner] - (np.arange(len(starts)) - begin[owner])
    short = counts < words
    at = np.flatnonzero((left >= words) | (short[owner] & (left == counts[owner])))
    total = np.zeros(len(at), np.uint64)
    width = np.minimum(left[at], words)
    for k in range(words):
        there = width > k
        total[there] += word[at[there] + k] * _PLACES[k % 64]
    found = _mixed(total + width.astype(np.uint64))
    order = np.lexsort((found, owner[at]))
    found, of = found[order], owner[at][order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], np.cumsum(np.bincount(of[new], minlength=len(texts)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _nodes(found: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A name for each set: 0 for an empty one."""
    sizes = np.diff(ends, prepend=0)
    out = np.zeros(len(ends), np.uint64)
    if len(found):
        some = sizes > 0
        out[some] = _mixed(np.add.reduceat(_mixed(found), (ends - sizes)[some]) + sizes[some].astype(np.uint64))
    return out


def sketches(rows: DataFrame, *, words: int, m: int, each: int = ROWS) -> DataFrame:
    """(id, node, size, a, b): the two collections of group keys, one row per row (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts, factors = _draw(3, 2 * m * each), _draw(4, 2 * m * each)
        for batch in portions(batches, "text", size=PORTION):
            found, ends = shingle_sets(batch.column(1), words)
            sizes = np.diff(ends, prepend=0)
            some = sizes > 0
            keys = np.zeros((2 * m, int(some.sum())), np.uint64)
            for g in range(2 * m):
                for k in range(g * each, (g + 1) * each):
                    least = np.minimum.reduceat((found ^ salts[k]) * factors[k], (ends - sizes)[some]) if some.any() else 0
                    keys[g] = _mixed(keys[g] * np.uint64(_BASE) + least)
                keys[g] = _mixed(keys[g] + np.uint64(g))
            edges = np.r_[0, np.cumsum(np.where(some, m, 0))].astype(np.int32)
            a = pa.ListArray.from_arrays(edges, _signed(np.ascontiguousarray(keys[:m].T).ravel()))
            b = pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(keys[m:].T).astype(np.uint16).view(np.int16).ravel()))
            columns = [batch.column(0), _signed(_nodes(found, ends)), pa.array(sizes.astype(np.int64)), a, b]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "size", "a", "b"])

    return mapped(rows, run, "id long, node long, size long, a array<long>, b array<short>")


def buckets(nodes: DataFrame, half: int = HALF) -> DataFrame:
    """(deal, nodes): the nodes of each bucket of two or more; of one with more than `half`, in
    several rows of no fewer than a crowd each. Rows of one `deal` hold few more than `half` nodes."""
    rows = nodes.select("node", F.explode("a").alias("a"), "b")
    hot = rows.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > half).select("a")
    # At most HOT of them for each group, so every task can have the list.
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "a", "left")
    alone = Window.partitionBy("a")
    met = marked.filter(F.col("hot").isNull()).repartition("a").withColumn("n", F.count("*").over(alone)).filter("n > 1")
    tables = met.select("a", "node", F.posexplode("b").alias("j", "b"))
    found = tables.groupBy("a", "j", "b").agg(F.collect_list("node").alias("nodes")).filter(F.size("nodes") > 1).select(F.col("a").alias("deal"), "nodes")
    # First halves that very many share: dealt by the whole key, in parts where that is hot too.
    dealt = marked.filter("hot").select("a", "node", F.posexplode("b").alias("j", "b"))
    counts = dealt.groupBy("a", "j", "b").agg(F.count("*").alias("n")).filter("n > 1")
    parts = dealt.join(counts, ["a", "j", "b"]).withColumn("part", F.pmod(F.hash("node"), F.ceil(F.col("n") / half).cast("int")))
    parted = parts.groupBy("a", "j", "b", "part").agg(F.collect_list("node").alias("nodes"))
    return found.unionByName(parted.select(F.xxhash64("a", "j", "b", "part").alias("deal"), "nodes"))


def _pairs(nodes: Column) -> Column:
    """All pairs of a short array, as structs (a, b)."""
    rest = lambda i: F.slice(nodes, i + F.lit(2), F.greatest(F.lit(0), F.size(nodes) - i - F.lit(1)))
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return F.flatten(F.transform(nodes, lambda x, i: F.transform(rest(i), lambda y: pair(x, y))))


def _near(both: Column, x: Column, y: Column, near: tuple[int, int]) -> Column:
    """Whether sets of these sizes that share so many are linked, in whole numbers."""
    return both * sum(near) >= (x + y) * near[0]


def compared(pairs: DataFrame, texts: DataFrame, *, words: int, near: tuple[int, int]) -> DataFrame:
    """Those of `pairs` (a, b), distinct, whose sets are near; `texts` has (node, text) for all.

    The node of a pair that has more partners is its hub. A hub's set stands at the head of each
    CHUNK of its partners, which pass by as a stream.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    degrees = ends.groupBy("node").agg(F.count("*").alias("n"))
    sides = (degrees.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    counted = functools.reduce(lambda p, d: p.join(d, d.columns[0]), sides, pairs)
    first = F.struct("n_a", "a") > F.struct("n_b", "b")
    dealt = counted.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"),
        F.greatest("n_a", "n_b").alias("n"),
    ).withColumn("part", F.pmod(F.hash("node"), F.ceil(F.col("n") / CHUNK).cast("int")))
    roles = dealt.select("hub", "part", F.col("node"), F.lit(1).alias("side")).unionByName(
        dealt.select("hub", "part", F.col("hub").alias("node"), F.lit(0).alias("side")).distinct()
    )
    rows = texts.join(staged(roles, "minhash_roles"), "node").select("hub", "part", "side", "node", "text")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in portions(batches, "text", size=PORTION):
            found, ends = shingle_sets(batch.column(4), words)
            hubs, sides, nodes = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out = []
            for hub, side, node, own in zip(hubs, sides, nodes, np.split(found, ends[:-1])):
                if not side:
                    head = own
                    continue
                at = np.searchsorted(head, own)
                both = int((head[np.minimum(at, len(head) - 1)] == own).sum())
                if both * sum(near) >= (len(head) + len(own)) * near[0]:
                    out.append((hub, node))
            columns = [pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return mapped(rows, run, "a long, b long")


def _postings(texts: DataFrame, *, words: int, near: tuple[int, int]) -> DataFrame:
    """(s, node, size, pos): the prefixes of the sets, shingles that few of these share first; those
    that only one has take their places and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", size=PORTION // 2):
            found, ends = shingle_sets(batch.column(1), words)
            sizes = np.diff(ends, prepend=0)
            columns = [_signed(found), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["s", "node", "size"])

    rows = mapped(texts.select("node", "text"), run, "s long, node long, size int")
    shared = rows.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    live = rows.join(shared, "s")
    of = Window.partitionBy("node")
    placed = live.withColumn("pos", F.col("size") - F.count("*").over(of) + F.row_number().over(of.orderBy("df", "s")) - 1)
    least = F.ceil(F.col("size") * near[0] / F.lit(near[1]))
    return placed.filter(F.col("pos") <= F.col("size") - least).select("s", "node", "size", "pos")


def _reach(x: dict[str, Column], y: dict[str, Column], near: tuple[int, int]) -> Column:
    """Whether two sets can be near that share the shingle at these places and none before."""
    left = 1 + F.least(x["size"] - x["pos"] - 1, y["size"] - y["pos"] - 1)
    return _near(left, x["size"], y["size"], near)


def crowd_links(texts: DataFrame, known: DataFrame, *, words: int, near: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join up all near nodes of `texts` (node, text), given links `known`.

    The pivot of a shingle is the node that has it first, so one with fewest shingles of its own:
    if any two nodes can be near by their places there, each can be near to it. What it is linked
    with is one component; then only pairs across components are compared, all of them.
    """
    postings = staged(_postings(texts, words=words, near=near), "minhash_postings")
    place = F.struct("pos", (-F.col("size")).alias("less"), "node")
    lists = postings.groupBy("s").agg(F.count("*").alias("n"), F.min(place).alias("p")).filter("n > 1")
    lists = lists.select("s", F.col("p.node").alias("pivot"), F.col("p.pos").alias("p_pos"), (-F.col("p.less")).alias("p_size"))
    live = staged(postings.join(lists, "s"), "minhash_lists")
    own, pivot = ({n: F.col(p + n) for n in ("size", "pos")} for p in ("", "p_"))
    stars = live.filter((F.col("pivot") != F.col("node")) & _reach(own, pivot, near))
    stars = staged(stars.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "minhash_stars")
    one_way = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    linked = staged(compared(one_way, texts, words=words, near=near), "minhash_linked")
    roots = components(linked.unionByName(known))
    named = live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = roots.select(F.col("node").alias("pivot"), F.col("root").alias("p_root"))
    named = named.join(heads, "pivot", "left").withColumn("p_root", F.coalesce("p_root", "pivot")).select("s", "node", "size", "pos", "root", "p_root", "pivot")
    named = staged(named, "minhash_named")
    x, y = (named.select("s", *[F.col(c).alias(f"{c}{i}") for c in ("node", "size", "pos", "root", "p_root", "pivot")]) for i in "12")
    sides = ({n: F.col(f"{n}{i}") for n in ("size", "pos")} for i in "12")
    across = (F.col("root1") != F.col("root2")) & (F.col("node1") != F.col("pivot1")) & (F.col("node2") != F.col("pivot1"))
    rest = x.filter("root1 != p_root1").join(y, "s").filter(across & _reach(*sides, near))
    rest = rest.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
    return linked.unionByName(compared(staged(rest, "minhash_rest"), texts, words=words, near=near))


def near_links(rows: DataFrame, *, words: int = WORDS, near: tuple[int, int] = NEAR, crowd: int = CROWD, half: int = HALF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marks, nodes, links) of `rows` (id, text): marks (id, node, size), nodes (node, least, size)
    of sets that are not empty, and links (a, b) of nodes, which join up all near ones."""
    marks = staged(sketches(rows, words=words, m=groups(near)), "minhash_marks")
    nodes = marks.filter("size > 0").groupBy("node").agg(F.min("id").alias("least"), F.first("size").alias("size"))
    nodes = staged(nodes, "minhash_nodes")
    half = max(half, nodes.count() // HOT)
    met = staged(buckets(marks.filter("size > 0").select("node", "a", "b").dropDuplicates(["node"]), half), "minhash_buckets")
    # A node stands in many tables of one deal, and leaves it once.
    large = met.filter(F.size("nodes") > crowd).groupBy("deal").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("nodes"))
    crowded = staged(large.select(F.explode("nodes").alias("node")).distinct(), "minhash_crowd")
    pairs = met.filter(F.size("nodes") <= crowd).select(F.inline(_pairs(F.col("nodes")))).distinct()
    # Pairs of crowded nodes are left to the join of those.
    inside = [crowded.select(F.col("node").alias(c), F.lit(True).alias(f"in_{c}")) for c in "ab"]
    pairs = pairs.join(inside[0], "a", "left").join(inside[1], "b", "left").filter("in_a IS NULL OR in_b IS NULL")
    sizes = [nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}")) for c in "ab"]
    pairs = pairs.join(sizes[0], "a").join(sizes[1], "b")
    pairs = pairs.filter(_near(F.least("size_a", "size_b"), F.col("size_a"), F.col("size_b"), near))
    pairs = staged(pairs.select("a", "b"), "minhash_pairs")
    texts = staged(_texts(rows, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded).distinct(), words), "minhash_texts")
    found = staged(compared(pairs, texts, words=words, near=near), "minhash_links")
    if not crowded.isEmpty():
        few = texts.join(crowded, "node", "left_semi")
        found = staged(found.unionByName(crowd_links(few, found, words=words, near=near)), "minhash_links")
    return marks.select("id", "node", "size"), nodes, found


def _texts(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, text) for each wanted node: the text of its smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", size=PORTION):
            named = _nodes(*shingle_sets(batch.column(1), words))
            yield pa.RecordBatch.from_arrays([*batch.columns, _signed(named)], ["id", "text", "node"])

    # An id may stand on several texts, and several rows on one id, so both names must agree.
    named = mapped(rows, run, "id long, text string, node long").withColumn("key", F.coalesce("id", F.lit(0).cast("long")))
    keys = nodes.join(wanted, "node", "left_semi").select("node", F.coalesce("least", F.lit(0).cast("long")).alias("key"))
    return named.select("node", "key", "text").join(keys.hint("merge"), ["node", "key"], "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", empty_alike: bool = False, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per input row.

    `component_id` is the smallest id reachable over links, the row's own included; rows of equal
    sets are always linked. A null or empty text, or one of white space, has no shingles and is
    linked with nothing, or with its like if `empty_alike`. Ids are cast to long: those that are no
    numbers count as null. Null ids never name a component: one of null ids alone has a null id,
    and keeps all its rows. Repeated rows are rows each. Empty tables give no rows; other columns
    take no part.
    """
    rows = docs.select(F.expr(f"try_cast(`{id_col}` AS bigint)").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks, nodes, links = near_links(rows, **options)
    rooted = nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = marks.filter("size > 0").join(named, "node").select("id", "size", "component_id")
    bare = marks.filter("size = 0")
    least = bare.agg(F.min("id")).scalar() if empty_alike else F.col("id")
    out = out.unionByName(bare.select("id", "size", least.alias("component_id")))
    return out.select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each component, that with the smallest id; of rows repeated under one
    id and text, one. Rows with a null id stay: nothing else names them."""
    named = docs.filter(F.col(id_col).isNotNull())
    found = near_copies(named, id_col=id_col, text_col=text_col, empty_alike=True, **options)
    return keep_least(docs, found, id_col=id_col, text_col=text_col)


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (s) JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING count(*) * {sum(NEAR)} >= (p.n + q.n) * {NEAR[0]}),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY 1) c USING (doc_id)"""
