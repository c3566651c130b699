"""Packing documents into windows by lexical retrieval.

Documents are encoded once into pieces of a window and a rest. Term counts and the mean length
of all pieces give BM25 its statistics. Whole windows are done; rests are ordered by content, the
leaders of a small sample that score best for each, so that lexical neighbours lie together, and a
range of that order is packed by one task. There rests fill shards of bounded size; each shard has
an inverted index, in which the document that opens a window finds its nearest unused neighbours,
and those fill the window. The one that no longer fits is cut, and its remainder opens the next
window, so every window is full. What is left at the end of a task is cut into lengths that are
powers of two, which need no padding either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from .tables import mapped, portions
from .tokens import encoder, vocabulary

#: Ids in a window, and the id that ends each document.
WINDOW = 2048
END = 1
#: Documents in a shard of the index, and shards a task fills; more where the table has over
#: MOST times as many documents, whose bounds would burden the driver.
SHARD, SHARDS, MOST = 1024, 4, 20_000
#: Sampled pieces that lend the shards their order, and how many of them a piece's key names.
LEADERS, DEPTH = 64, 6
#: Places under one key, among which rows of equal keys are dealt.
PLACES = 1 << 16
#: A term of more than one in so many of a shard's documents is scored as a dense row.
OFTEN = 16
#: Fixed values of BM25.
K1, B = 1.2, 0.75

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, row long"
OUT = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _ids(data: bytes, length: int) -> np.ndarray:
    """The ids of a piece, which are stored in two bytes each where all of them fit."""
    return np.frombuffer(data, f"<u{len(data) // length}")


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of a piece, ascending, and how often each stands there."""
    ordered = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[first], np.diff(np.r_[first, len(ordered)])


@dataclass(frozen=True)
class Statistics:
    """What BM25 knows of all pieces: the weight of each term, and the mean length."""

    idf: np.ndarray
    mean: float

    @classmethod
    def of(cls, pieces: int, tokens: int, df: np.ndarray) -> Statistics:
        idf = np.log1p((pieces - df + 0.5) / (df + 0.5)).astype(np.float32)
        return cls(idf, tokens / max(1, pieces))

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The score that each term adds for a query that has it."""
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


class Index:
    """A BM25 inverted index over the token ids of a shard's documents.

    Weights follow `statistics`, those of the whole table, or of the shard where it is all there is.
    """

    def __init__(self, docs: list[np.ndarray], statistics: Statistics | None = None):
        own = [counted(ids) for ids in docs]
        self.own = [terms for terms, _ in own]
        self.size = len(docs)
        term, tf = np.concatenate(self.own), np.concatenate([n for _, n in own])
        owner = np.repeat(np.arange(self.size, dtype=np.int32), [len(t) for t in self.own])
        length = np.array([len(d) for d in docs])
        self.df = df = np.bincount(term, minlength=int(term.max()) + 1)
        statistics = statistics or Statistics.of(self.size, int(length.sum()), df)
        weight = statistics.weights(term, tf, length[owner])
        # Terms of many documents are rows of a dense table, the others lists of postings.
        often = df * OFTEN > self.size
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), self.size), np.float32)
        here = often[term]
        self.dense[self.row[term[here]], owner[here]] = weight[here]
        term, owner, weight = term[~here], owner[~here], weight[~here]
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(np.where(often, 0, df))])

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first by all of its terms; ties
        to the earlier document. Terms that the seed alone has add nothing and are skipped."""
        own = self.own[seed]
        own = own[self.df[own] > 1]
        if not len(own):
            return np.zeros(0, np.int64)
        rows = self.row[own]
        picked = np.zeros(len(self.dense), np.float32)
        picked[rows[rows >= 0]] = 1
        scores = (picked @ self.dense).astype(np.float64)
        own = own[rows < 0]
        first, count = self.start[own], self.start[own + 1] - self.start[own]
        if len(own):
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            scores += np.bincount(self.owner[at], self.weight[at], self.size)
        found = np.flatnonzero((scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")]


class Packer:
    """Gives each rest of a document its place; `out` collects (row, start, length, ids, tokens,
    sequence, offset)."""

    def __init__(self, window: int, first: int, statistics: Statistics):
        self.window, self.sequence, self.statistics = window, first, statistics
        self.docs: list[tuple[int, int, int, np.ndarray]] = []  # row, start, tokens, ids
        self.open: list[tuple[int, int, int, np.ndarray]] = []  # pieces of the window being filled
        self.filled = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple[int, int, int, np.ndarray]]) -> None:
        offset = 0
        for row, start, n, ids in pieces:
            self.out.append((row, start, len(ids), ids.astype("<u4").tobytes(), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def place(self, piece: tuple[int, int, int, np.ndarray]) -> None:
        """Add a piece to the open window; a window that is full goes out."""
        row, start, n, ids = piece
        room = self.window - self.filled
        self.open.append((row, start, n, ids[:room]))
        self.filled += min(room, len(ids))
        if self.filled == self.window:
            self.emit(self.open)
            self.open, self.filled = [], 0
            if len(ids) > room:
                self.place((row, start + room, n, ids[room:]))

    def shard(self) -> None:
        """Place all waiting documents."""
        if not self.docs:
            return
        index = Index([d[3] for d in self.docs], self.statistics)
        unused = np.ones(index.size, bool)
        seed, queue, at = 0, np.zeros(0, np.int64), 0
        for doc in range(index.size):
            if not unused[doc]:
                continue
            seed = doc
            while True:
                unused[seed] = False
                before = self.sequence
                self.place(self.docs[seed])
                if self.sequence != before:
                    # Its rest opens the next window, and looks for neighbours of its own.
                    if not self.filled:
                        break
                    queue, at = index.neighbours(seed, unused), 0
                elif len(self.open) == 1:
                    queue, at = index.neighbours(seed, unused), 0
                while at < len(queue) and not unused[queue[at]]:
                    at += 1
                if at == len(queue):
                    break
                seed = int(queue[at])
        self.docs = []

    def finish(self) -> None:
        """Place what is left, in lengths that are powers of two."""
        self.shard()
        pieces, left = self.open, self.filled
        while left:
            size, taken = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                row, start, n, ids = pieces[0]
                cut = min(size, len(ids))
                taken.append((row, start, n, ids[:cut]))
                size -= cut
                pieces = pieces[1:] if cut == len(ids) else [(row, start + cut, n, ids[cut:]), *pieces[1:]]
            self.emit(taken)
        self.open, self.filled = [], 0


def pieces(docs: DataFrame, *, id_col: str, text_col: str, path: str, window: int, end: int) -> DataFrame:
    """(id, PIECES), in the shared folder: the whole windows of each document, which are sequences
    already, and its rest, whose sequence is null. `row` numbers them all."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        row = TaskContext.get().partitionId() << 33
        for batch in portions(batches, "text", size=4 << 20):
            cols: list[list] = [[] for _ in range(7)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), end)
                ids = ids.astype("<u2" if ids.max() < 65536 else "<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    sequence = row if len(piece) == window else None
                    for col, x in zip(cols, (i, at, len(piece), piece.tobytes(), len(ids), sequence, row)):
                        col.append(x)
                    row += 1
            own = batch.column(0).take(pa.array(cols[0], pa.int64()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            arrays = [own, *(pa.array(c, k) for c, k in zip(cols[1:], kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *_names(PIECES)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return staged(mapped(rows, run, f"id {key}, {PIECES}"), "pieces")


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def statistics(parts: DataFrame) -> Statistics:
    """BM25's statistics of all pieces; a task sends one row per distinct term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, count, tokens = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for data, length in zip(*(c.to_pylist() for c in batch.columns)):
                terms, _ = counted(_ids(data, length))
                if terms[-1] >= len(df):
                    df = np.append(df, np.zeros(int(terms[-1]) + 1 - len(df), np.int64))
                df[terms] += 1
                count, tokens = count + 1, tokens + length
        term = np.flatnonzero(df)
        cols = [np.r_[-2, -1, term], np.r_[count, tokens, df[term]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["term", "n"])

    sums = mapped(parts.select("ids", "length"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}  # as many as the vocabulary has, and two
    df = np.zeros(max([0, *found]) + 1, np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return Statistics.of(found.get(-2, 0), found.get(-1, 0), df)


class Leaders:
    """Pieces by whose scores all others are ordered.

    A piece's key names its DEPTH best leaders, best first, ties to the earlier one. Pieces that
    begin alike share words with the same leaders, and the further names part them ever finer, so
    the same few leaders serve a table of any size.
    """

    def __init__(self, docs: list[np.ndarray], known: Statistics):
        self.known = known
        terms = [counted(ids)[0] for ids in docs]
        self.size = len(docs)
        every = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.int64)
        self.slot = np.full(len(known.idf), -1, np.int32)
        self.slot[every] = np.arange(len(every))
        self.has = np.zeros((len(every), self.size), np.float32)
        for i, own in enumerate(terms):
            self.has[self.slot[own], i] = 1

    def key(self, ids: np.ndarray) -> int:
        terms, tf = counted(ids)
        slot = self.slot[terms]
        met = slot >= 0
        scores = self.known.weights(terms[met], tf[met], len(ids)).astype(np.float32) @ self.has[slot[met]]
        key = 0
        for i in np.argsort(-scores, kind="stable")[:DEPTH].tolist():
            key = key * self.size + i
        return key


def leaders(parts: DataFrame, known: Statistics, size: int = LEADERS) -> Leaders:
    """`size` distinct pieces, first by a hash of their rows, among four times as many (fewer where
    those repeat)."""
    hashed = parts.select("ids", "length", "row").orderBy(F.xxhash64("row"), "row").limit(4 * size)
    texts = dict.fromkeys((bytes(r["ids"]), r["length"]) for r in hashed.collect())
    return Leaders([_ids(*t) for t in list(texts)[:size]], known)


def routed(rests: DataFrame, lead: Leaders, bounds: np.ndarray | None = None) -> DataFrame:
    """`rests` with their `place` in the order: the key, then one of PLACES by the row's number.
    With bounds of ranges, also `range`, the number of bounds that are not above the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(*(batch.column(c).to_pylist() for c in ("ids", "length", "row")))
            # An odd factor spreads neighbouring numbers over the places.
            place = np.array([lead.key(_ids(d, n)) * PLACES + row * 40503 % PLACES for d, n, row in sets], np.int64)
            more = [place] if bounds is None else [place, np.searchsorted(bounds, place, "right").astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], [*batch.schema.names, *names])

    names = ["place"] if bounds is None else ["place", "range"]
    kinds = dict(zip(names, ("long", "int")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rests.schema]
    return mapped(rests, run, ", ".join(fields + [f"{n} {k}" for n, k in kinds.items()]))


def ordered(rests: DataFrame, lead: Leaders, ranges: int) -> DataFrame:
    """`rests` with place and range, each range in a partition of its own, in order of place."""
    inner = [i / ranges for i in range(1, ranges)]
    bounds = np.zeros(0, np.int64)
    if inner:
        places = routed(rests.select("ids", "length", "row"), lead)
        found = places.agg(F.percentile_approx("place", inner, 5 * ranges).alias("at")).first()["at"]
        bounds = np.array(found or [], np.int64)
    return routed(rests, lead, bounds).repartitionById(ranges, "range").sortWithinPartitions("place", "row")


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    window: int = WINDOW,
    shard: int = SHARD,
    end: int = END,
) -> DataFrame:
    """One row per piece: the id column, start, length, `ids` (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    Each row of `docs` is one document, repeated rows too, whatever its id; a null or empty text
    is the ending id alone. Pieces of a document do not overlap and cover it; pieces of a
    sequence have no gaps. A sequence has `window` ids, or fewer at a power of two. Statistics are
    of all pieces of the table; a seed's neighbours are those of its shard, in which rests of
    like content lie. The leaders of that order are a bounded sample (`LEADERS`), and rests of
    equal keys, copies for one, are dealt over places by their number, so that no range is large
    for them.
    """
    if window < 1 or window & (window - 1):
        raise ValueError(f"window must be a power of two, got {window}")
    parts = pieces(docs, id_col=id_col, text_col=text_col, path=path or vocabulary(), window=window, end=end)
    key = parts.schema["id"].dataType.simpleString()
    known = statistics(parts)
    rests = parts.filter(F.col("sequence_id").isNull()).drop("sequence_id")
    ranges = min(MOST, math.ceil(rests.count() / (SHARDS * shard)) or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, (1 << 62) + (TaskContext.get().partitionId() << 33), known)
        held: dict[int, object] = {}
        rows, kind = 0, None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*packer.out)) or [()] * 7
            packer.out = []
            ids = pa.array([held[r] for r in cols[0]], kind)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            alive = {p[0] for p in [*packer.open, *packer.docs]}
            for r in set(held) - alive:
                del held[r]
            arrays = [ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds))]
            return pa.RecordBatch.from_arrays(arrays, ["id", *_names(OUT)])

        for batch in batches:
            kind = batch.schema.field(0).type
            for value, start, length, data, n in zip(*(c.to_pylist() for c in batch.columns)):
                held[rows] = value
                packer.docs.append((rows, start, n, _ids(data, length)))
                rows += 1
                if len(packer.docs) == shard:
                    packer.shard()
                    yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [_ids(d, window).astype("<u4").tobytes() for d in batch.column("ids").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(wide, pa.binary()))

    columns = ["id", "start", "length", "ids", "doc_tokens"]
    filled = mapped(ordered(rests, leaders(parts, known), ranges).select(columns), run, f"id {key}, {OUT}")
    whole = parts.filter(F.col("sequence_id").isNotNull()).select(*columns, "sequence_id", F.lit(0).cast("long").alias("offset"))
    return mapped(whole, widened, f"id {key}, {OUT}").unionByName(filled).withColumnRenamed("id", id_col)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of them."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
