"""A Merkle manifest of a table, with proofs from few stored levels.

Each row is a leaf; the leaves of a source form a tree of threes, and the sources' roots another
one. Of a tree only every few levels are written: the leaves, then the nodes `every` levels up,
and so on. A stored node stands for an aligned subtree of at most 3^every stored nodes below it.
Building reads each such block once and keeps its top. Proving reads it once more, from the top
down: the missing levels of the block are computed anew from what is stored below it, each node
gets its siblings in them and those of the nodes above, and the levels are let go.

A block is the most that a task holds. Leaves are numbered by bucket totals, so no source, however
large, is sorted in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.ordering import BUCKET, prefix_sums, range_bucket
from ..plans.stage import staged

#: Children of a node, and levels between two that are stored.
FAN = 3
EVERY = 4
#: Buckets that leaves are numbered in, a power of two.
BUCKETS = 1024
#: The columns of `documents` that a leaf covers, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "struct<left string, right string>"


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the sources' trees and of the tree above them, lowest first, as tables
    (tree, pos, n, hash), n being the tree's leaves; those of level 0 have the carried columns
    too. `subroots` has (tree, hash), `root` one row (hash), or none for an empty table."""

    levels: list[DataFrame]
    tops: list[DataFrame]
    subroots: DataFrame
    root: DataFrame
    every: int


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of the values one after the other: bytes, colon and value, or `-` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts]), 256)


def tree_name(source: Column) -> Column:
    """A name for every source, null too, in the order of the sources: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(40)]), lambda size: size < n))


def _levels(hashes: list[str], rise: int) -> list[list[str]]:
    """The level given and `rise` more: each run of FAN nodes becomes one, a shorter last run too."""
    found = [hashes]
    for _ in range(rise):
        below = found[-1]
        found.append([hashlib.sha256("".join(below[i : i + FAN]).encode()).hexdigest() for i in range(0, len(below), FAN)])
    return found


def _blocks(level: DataFrame, base: int, every: int) -> DataFrame:
    """(tree, block, n, items, rise): the nodes of each aligned subtree, in order, at most
    FAN^every, and the levels it still has to rise."""
    items = ["pos", *[c for c in level.columns if c not in ("tree", "pos", "n")]]
    return (
        level.groupBy("tree", F.floor(F.col("pos") / FAN**every).alias("block"), "n")
        .agg(F.array_sort(F.collect_list(F.struct(*items))).alias("items"))
        .withColumn("rise", F.greatest(F.lit(0), F.least(F.lit(every), _height(F.col("n")) - base)))
    )


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = [_levels(h, r)[-1][0] for h, r in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tops, pa.string())], ["tree", "pos", "n", "hash"])


def _built(leaves: DataFrame, every: int) -> tuple[list[DataFrame], DataFrame]:
    """(stored levels, roots) of the trees that these numbered leaves (tree, pos, n, hash) form."""
    levels = [leaves]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    base = 0
    while True:
        blocks = _blocks(levels[-1].select("pos", "hash", "tree", "n"), base, every)
        above = blocks.select("tree", F.col("block").alias("pos"), "n", F.col("items.hash").alias("hashes"), "rise")
        above = staged(above.mapInArrow(_tops, "tree string, pos long, n long, hash string"), "merkle_level")
        base += every
        if largest <= FAN**base:
            return levels, above.select("tree", "hash")
        levels.append(above)


def _numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """`rows` with pos, from 0 within `by`, and n, the rows there."""
    placed = prefix_sums(rows, by=[by], order=order, sums={"pos": F.lit(1)}, wholes={"n": "pos"})
    return placed.withColumn("pos", F.col("pos") - 1)


def build(leaves: DataFrame, *, order: str, every: int = EVERY, buckets: int = BUCKETS) -> Manifest:
    """The manifest of `leaves` (tree, hash, the column `order`, a number, and others to carry).

    Leaves stand by `order`, null first, and where that is equal by hash. A tree of one leaf is
    that leaf. An empty table has no root.
    """
    keyed = range_bucket(staged(leaves, "merkle_leaves"), order, buckets)
    levels, roots = _built(staged(_numbered(keyed, "tree", [F.col(order).asc_nulls_first(), "hash"]), "merkle_level"), every)
    roots = staged(roots, "merkle_roots")
    # Sources in the order of their bytes: the first three after the mark make a bucket.
    spelled = roots.withColumn(BUCKET, F.conv(F.rpad(F.substring(F.hex("tree"), 3, 6), 6, "0"), 16, 10).cast("int"))
    ranked = _numbered(spelled.withColumn("forest", F.lit("")), "forest", ["tree"])
    top = ranked.select(F.col("forest").alias("tree"), "pos", "n", "hash", F.col("tree").alias("member"))
    tops, root = _built(staged(top, "merkle_top"), every)
    return Manifest(levels, tops, roots, root.select("hash"), every)


def _siblings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = []
        hashes = batch.column(batch.schema.get_field_index("hashes")).to_pylist()
        for nodes, rise in zip(hashes, batch.column(batch.schema.get_field_index("rise")).to_pylist()):
            levels = _levels(nodes, rise)[:-1]
            paths = []
            for i in range(len(nodes)):
                steps = []
                for level in levels:
                    first = i - i % FAN
                    steps.append({"left": "".join(level[first:i]), "right": "".join(level[i + 1 : first + FAN])})
                    i //= FAN
                paths.append(steps)
            own.append(paths)
        kind = pa.list_(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, kind)], [*batch.schema.names, "own"])


def _paths(levels: list[DataFrame], above: DataFrame, every: int) -> DataFrame:
    """The leaves with `path`, the siblings of every node up to the root, and what `above`
    (tree, path, others) has for each tree's root."""
    extra = [c for c in above.columns if c not in ("tree", "path")]
    up = above.select("tree", F.lit(0).cast("long").alias("block"), "path", *extra)
    for at, level in reversed([*enumerate(levels)]):
        blocks = _blocks(level, at * every, every).join(up, ["tree", "block"])
        blocks = blocks.withColumn("hashes", F.col("items.hash"))
        whole = blocks.mapInArrow(_siblings, StructType([*blocks.schema.fields, *StructType.fromDDL(f"own array<array<{_STEP}>>").fields]))
        each = whole.select("tree", "path", *extra, F.inline(F.arrays_zip("items", "own")))
        up = each.select("tree", *extra, "items.*", F.concat("own", "path").alias("path"))
        if at:
            up = up.select("tree", F.col("pos").alias("block"), "path", *extra)
    return up


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: tree, pos, hash, the carried columns, subroot, root and `path`, an array
    of (left, right): the siblings on both sides of the leaf's node at each level, joined."""
    none = F.array().cast(f"array<{_STEP}>")
    crown = manifest.root.select(F.lit("").alias("tree"), none.alias("path"), F.col("hash").alias("root"))
    heads = _paths(manifest.tops, crown, manifest.every)
    heads = staged(heads.select(F.col("member").alias("tree"), "path", F.col("hash").alias("subroot"), "root"), "merkle_heads")
    return _paths(manifest.levels, heads, manifest.every)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None, *, id_col: str = "doc_id", source_col: str = "source", columns=COLUMNS, **options) -> Manifest:
    """The manifest of the rows of `docs`, a tree per source, leaves by id.

    Any column may be null; the null source is a tree of its own and rows without an id come
    first in theirs. Rows repeated whole are leaves each. `carried` names expressions over `docs`
    kept beside each leaf. Columns that `columns` does not name take no part, whatever they are
    called.
    """
    leaves = docs.select(
        tree_name(F.col(source_col)).alias("tree"),
        leaf_hash(*[F.col(c) for c in columns]).alias("hash"),
        F.col(id_col).alias("id"),
        *[c.alias(n) for n, c in (carried or {}).items()],
    )
    return build(leaves, order="id", **options)


def audit(docs: DataFrame, **options) -> DataFrame:
    """Every row proved, against a copy in which each row whose crc32 of the id is even has lost
    the line ends of its text: the columns of the contract, and `path`. A null id counts as an
    odd one."""
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    again = leaf_hash(*[text if c == "text" else F.col(c) for c in COLUMNS])
    found = proofs(manifest(docs, {"seen": again}, **options))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    out = found.select(
        F.col("id").alias("doc_id"),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("seen"), F.col("path")).alias("folded_root"),
        "path",
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def digest(audited: DataFrame) -> DataFrame:
    """The audit without the siblings themselves."""
    return audited.drop("path")


#: crc32 of `{0}`, an expression of ASCII text, bit by bit.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda s: ascii(s)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""


def _part(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || {c} END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_part(text if c == "text" else c) for c in COLUMNS) + ")"


ORACLE = f"""WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN {CRC32_SQL.format('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS seen
  FROM documents),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
subs AS (SELECT tree, lvl AS height, h FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, tree AS pos, count(*) OVER () AS n, h FROM subs
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
nodes AS (SELECT tree, lvl, pos, h FROM up WHERE n > 1
  UNION ALL SELECT s.tree, s.height + t.lvl, t.pos, t.h FROM subs s, top t WHERE t.n > 1),
walk AS (SELECT doc_id, leaf, seen, tree, lvl, CASE WHEN lvl < height THEN floor(pos / 3 ** lvl) ELSE floor(tree / 3 ** (lvl - height)) END::BIGINT AS spot, row_id
  FROM (SELECT *, row_number() OVER () AS row_id FROM leaves) JOIN subs USING (tree), (SELECT DISTINCT lvl FROM nodes)),
steps AS (SELECT row_id, walk.lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < spot), '') AS l, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > spot), '') AS r
  FROM walk JOIN nodes ON nodes.tree = walk.tree AND nodes.lvl = walk.lvl AND nodes.pos // 3 = spot // 3 GROUP BY ALL),
fold AS (SELECT DISTINCT row_id, 0 AS lvl, seen AS h, '' AS proof FROM walk
  UNION ALL SELECT row_id, lvl + 1, sha256(l || h || r), proof || l || r FROM fold JOIN steps USING (row_id, lvl)),
ends AS (SELECT row_id, arg_max(h, lvl) AS folded_root, sha256(arg_max(proof, lvl)) AS proof_sha256 FROM fold GROUP BY row_id),
named AS (SELECT DISTINCT row_id, doc_id, leaf, tree FROM walk)
SELECT doc_id, leaf, subs.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM named JOIN ends USING (row_id) JOIN subs USING (tree), (SELECT h AS root FROM top WHERE n = 1)"""
