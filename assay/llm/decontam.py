"""Benchmark decontamination by word n-grams.

The benchmark's windows become a hash set that every task holds; documents are scanned whole,
their windows looked up by hash and each hit verified word by word. The set is broadcast in
blocks of items whose windows are counted first, so its size is bounded however large the
benchmark: a larger one takes more scans, none of which shuffles a document.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import mapped, portions, put_back, set_aside

#: Words in a window.
WINDOW = 13
#: Windows of one broadcast block, some 200 bytes each.
BLOCK_WINDOWS = 400_000
HITS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("item", pa.string())]))

COLUMNS = ["words", "hit_words", "hits"]

#: A word of a text that is not lower-cased.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _table() -> bytes:
    """Byte map: A-Z to a-z, digits, letters and bytes of other characters as they are, else a space."""
    kept = lambda b: b >= 0x80 or chr(b).isalnum()
    return bytes(ord(chr(b).lower()) if b < 0x80 and kept(b) else b if kept(b) else 32 for b in range(256))


def cut_words(text: bytes | None, table: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of digits, letters and non-ASCII characters."""
    return text.translate(table).split() if text else []


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), lambda w: w != ""))


def windows_of(items: list[tuple[str | None, bytes]], window: int) -> tuple[dict, dict]:
    """The windows of a block of items: ids from 1 by word, and by length the sorted hashes, the
    ids in each window, and the items that hold it (None: one without an id)."""
    table = _table()
    vocabulary: dict[bytes, int] = {}
    rows: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = cut_words(text, table)
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        size = min(window, len(ids))
        for at in range(len(ids) - size + 1 if size else 0):
            rows[size][tuple(ids[at : at + size])].add(item)
    by_length = {}
    for size, found in rows.items():
        ids = np.array(list(found), np.uint64).reshape(len(found), size)
        hashes = _hashed(ids.T)
        order = np.argsort(hashes, kind="stable")
        owners = [sorted(x, key=lambda item: (item is None, item)) for x in found.values()]
        by_length[size] = hashes[order], ids[order], [owners[i] for i in order]
    return vocabulary, by_length


def _hashed(columns: Iterable[np.ndarray]) -> np.ndarray:
    out = np.uint64(0)
    for column in columns:
        out = out * np.uint64(0x9E3779B97F4A7C15) + column
        out ^= out >> np.uint64(29)
    return out


def occurrences(by_length: dict, ids: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
    """(position, length, items) of every window that occurs in `ids`; 0 is no word of any."""
    gaps = np.concatenate([[0], np.cumsum(ids == 0)])
    for size, (hashes, rows, owners) in by_length.items():
        if len(ids) < size:
            continue
        at = np.flatnonzero(gaps[size:] == gaps[:-size])
        found = _hashed(ids[at + k] for k in range(size))
        low, high = (np.searchsorted(hashes, found, side) for side in ("left", "right"))
        for i in np.flatnonzero(low < high):
            for row in range(low[i], high[i]):
                if (rows[row] == ids[at[i] : at[i] + size]).all():
                    yield int(at[i]), size, owners[row]


def _scan(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vocabulary, by_length), table = shared.value, _table()
        known = vocabulary.get
        for batch in portions(batches, text_col):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            hits = batch.column("hits").to_pylist()
            words, ids, starts = [], [], [0]
            for text in texts:
                cut = cut_words(text, table)
                words.append(len(cut))
                ids += [known(w, 0) for w in cut]
                ids.append(0)
                starts.append(len(ids))
            for at, size, items in occurrences(by_length, np.array(ids, np.uint64)):
                doc = int(np.searchsorted(starts, at, "right")) - 1
                start = at - starts[doc]
                hits[doc] += [{"start": start, "stop": start + size, "item": item} for item in items]
            covered = [len(span_words(h)) if h else 0 for h in hits]
            names = batch.schema.names
            own = {"words": pa.array(words, pa.int64()), "hit_words": pa.array(covered, pa.int64()), "hits": pa.array(hits, HITS)}
            yield pa.RecordBatch.from_arrays([own.get(n, batch.column(n)) for n in names], names)

    return run


def span_words(hits: list[dict]) -> set[int]:
    """The word positions that any of the hits covers."""
    return {i for h in hits for i in range(h["start"], h["stop"])}


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[list]:
    """Distinct items in blocks of about `most` windows each; items without words are left out."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    items = items.withColumn("n", word_count(F.col("text"))).filter("n > 0")
    total = items.agg(F.sum(F.greatest(F.col("n") - window + 1, F.lit(1)))).first()[0] or 0
    count = math.ceil(total / most)
    for block in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block) if count > 1 else items
        yield [(r["item"], r["text"].encode()) for r in rows.select("item", "text").collect()]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """`docs` with `words` (long), `hit_words` (long: words inside any occurrence of a window)
    and `hits`: each occurrence as word positions [start, stop) and its item.

    An item of fewer words than a window is one window; one without words has none. A null or
    empty text has no words and no hits; the hits of items without an id have a null item.
    Repeated items count once. Rows of `docs` stay as they are, repeated ones too. Columns of `docs` named like the new ones are replaced.
    """
    if window < 1:
        raise ValueError(f"window must be at least 1, got {window}")
    text = F.col(text_col).cast("string")
    rows = docs.withColumns(
        {
            text_col: text,
            "words": F.coalesce(word_count(text), F.lit(0)).cast("long"),
            "hit_words": F.lit(0).cast("long"),
            "hits": F.array().cast("array<struct<start:int,stop:int,item:string>>"),
        }
    )
    for items in _blocks(benchmark, item_col, item_text_col, window, block_windows):
        shared = docs.sparkSession.sparkContext.broadcast(windows_of(items, window))
        # The task counts the words itself.
        rows = rows.withColumn("words", F.lit(0).cast("long"))
        rows = mapped(rows, _scan(shared, text_col), T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
    return rows


def contaminated(share: int = 20) -> Column:
    """Any hit word, and at least one in `share` words hit."""
    return (F.col("hit_words") > 0) & (F.col("hit_words") * share >= F.col("words"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per scanned row: counts, items that have an id, and the verdict."""
    items = F.array_sort(F.array_distinct(F.array_compact(F.transform("hits", lambda h: h["item"]))))
    return scanned.select(
        F.col(id_col),
        F.col("words").alias("n_words"),
        F.col("hit_words").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without contaminated rows; the others are left alone."""
    rows, names = set_aside(docs, COLUMNS)
    return put_back(scan(rows, benchmark, **options).filter(~contaminated()), names)


def _cut(text: str | None, hits: list[dict]) -> str | None:
    if not hits:
        return text
    covered, out, end = span_words(hits), [], 0
    spans = [m.span() for m in _WORD.finditer(text)]
    for i, (a, b) in enumerate(spans):
        if i in covered:
            # From the first covered word to just before the next word that stays.
            if i - 1 not in covered:
                out.append(text[end:a])
            end = spans[i + 1][0] if i + 1 < len(spans) else len(text)
    return "".join(out) + text[end:]


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """`docs` with every hit word cut out of the text, and what follows it up to the next word."""
    rows, names = set_aside(docs, COLUMNS)
    scanned = scan(rows, benchmark, text_col=text_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text_col):
            both = zip(batch.column(text_col).to_pylist(), batch.column("hits").to_pylist())
            cut = pa.array([_cut(text, hits) for text, hits in both], pa.string())
            kept = batch.schema.names
            yield pa.RecordBatch.from_arrays([cut if n == text_col else batch.column(n) for n in kept], kept)

    return put_back(mapped(scanned, run, scanned.schema), names)
