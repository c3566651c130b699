"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order character models are trained from labelled strings: one of random strings, one
of ordinary identifiers. A run of identifier characters is a secret if the first explains it
better, by a log-likelihood ratio per character.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import mapped, portions, put_back, set_aside

# Patterns, least lengths and the order of kinds.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A run of digits alone, or of letters alone, is no key.
_MIXED = re.compile(r"[A-Za-z].*[0-9]|[0-9].*[A-Za-z]")
_MASK = "[REDACTED]"

#: Characters that the models tell apart; all others are one class.
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Log-likelihood ratio per character from which a run counts as random.
MARGIN = 1.0
#: Pairs that the characters' own frequencies count for, beside the pairs seen.
BACK_OFF = 20

_CODES = np.full(256, len(ALPHABET), np.int64)
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio of each pair of characters: random over ordinary."""

    ratio: np.ndarray

    def score(self, text: str) -> float:
        codes = _CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
        return float(self.ratio[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0


def fit(samples: DataFrame, *, text_col: str = "text", label_col: str = "label") -> Models:
    """Models from labelled strings: label 1 is random, 0 ordinary. Spark counts the pairs of
    characters of every distinct string; rows with a null text or label, or of under two
    characters, say nothing."""
    text = F.col(text_col).cast("string")
    rows = samples.select(text.alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = rows.filter(F.col("label").isin(0, 1) & (F.length("text") > 1)).distinct()
    rows = rows.select("label", F.regexp_replace("text", f"[^{ALPHABET[:-1]}-]", " ").alias("text"))
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1))
    pairs = rows.select("label", "text", at.alias("i")).select("label", F.substring("text", F.col("i"), F.lit(2)).alias("pair"))
    counts = np.zeros((2, len(ALPHABET) + 1, len(ALPHABET) + 1))
    # At most one row per label and pair of classes of characters, counted before the shuffle.
    for r in pairs.groupBy("label", "pair").count().collect():
        a, b = (ALPHABET.find(c) if c in ALPHABET else len(ALPHABET) for c in r["pair"])
        counts[r["label"], a, b] += r["count"]
    # Characters seldom seen as a first one fall back on how often their second one is seen at all.
    alone = counts.sum(axis=1, keepdims=True) + 0.5
    alone /= alone.sum(axis=2, keepdims=True)
    logs = np.log((counts + BACK_OFF * alone) / (counts.sum(axis=2, keepdims=True) + BACK_OFF))
    return Models(logs[1] - logs[0])


def random_strings(count: int = 2000, seed: int = 7) -> list[str]:
    """Strings as key generators make them, over the usual alphabets and lengths."""
    draw = random.Random(seed)
    alphabets = ["0123456789abcdef", string.ascii_letters + string.digits, ALPHABET, string.ascii_uppercase + string.digits]
    return ["".join(draw.choices(alphabets[i % 4], k=draw.randint(16, 48))) for i in range(count)]


def labelled_strings(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(text, label): the distinct words of letters of all documents as ordinary identifiers,
    alone and joined in the usual ways; generated strings as random ones."""
    spark: SparkSession = docs.sparkSession
    words = docs.select(F.explode(F.array_distinct(F.split(F.col(text_col).cast("string"), "[^A-Za-z]+"))).alias("w"))
    words = words.filter(F.length("w").between(3, 24)).distinct()
    low = F.lower("w")
    joined = [low, F.concat(low, F.lit("_id")), F.concat(F.lit("get"), F.initcap("w")), F.upper("w"), F.concat(low, F.lit("-"), low)]
    number = F.pmod(F.xxhash64("w"), F.lit(10_000))
    day = F.date_add(F.lit("1990-01-01").cast("date"), number.cast("int")).cast("string")
    joined += [F.concat(low, number.cast("string")), F.concat(low, F.lit("_"), number.cast("string")), F.concat(day, F.lit("_"), low), F.concat(low, F.lit("-"), day)]
    ordinary = words.select(F.explode(F.array(*joined)).alias("text"), F.lit(0).alias("label"))
    return ordinary.unionByName(spark.createDataFrame([(s, 1) for s in random_strings()], "text string, label int"))


def find(text: str, models: Models, margin: float = MARGIN) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then as kinds are listed."""
    base = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    more = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        if _MIXED.search(m[0]) and not any(s < b and a < e for _, s, e in base) and models.score(m[0]) > margin:
            more.append(("random", a, b))
    return sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,stop:int>>"


def scan(docs: DataFrame, models: Models, *, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """`docs` with `spans` (kind, start, stop in code points) and `redacted`, the text with
    every span replaced.

    A null or empty text has no spans and stays as it is. Rows stay as they are, repeated ones
    too; columns of `docs` named like the new ones are replaced.
    """
    rows = docs.withColumns(
        {text_col: F.col(text_col).cast("string"), "spans": F.array().cast(SPANS), "redacted": F.lit(None).cast("string")}
    )
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            found = [find(t, models, margin) if t else [] for t in texts]
            own = {
                "spans": pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in f] for f in found], kind),
                "redacted": pa.array([redact(t, f) if f else None for t, f in zip(texts, found)], pa.string()),
            }
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([own.get(n, batch.column(n)) for n in names], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    scanned = mapped(rows, run, schema)
    return scanned.withColumn("redacted", F.coalesce("redacted", F.col(text_col)))


def mask(docs: DataFrame, models: Models, *, text_col: str = "text", size_col: str | None = "n_chars", margin: float = MARGIN) -> DataFrame:
    """`docs` with secrets masked in the text and, where one was, the size counted anew."""
    rows, names = set_aside(docs, ["spans", "redacted"])
    found = scan(rows, models, text_col=text_col, margin=margin)
    changed = {text_col: F.col("redacted")}
    if size_col in docs.columns:
        size = F.when(F.size("spans") > 0, F.length("redacted")).otherwise(F.col(size_col))
        changed[size_col] = size.cast(docs.schema[size_col].dataType)
    return put_back(found.withColumns(changed), names)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    for _, a, b in spans:
        if a >= end:  # else the last mask covers its start
            out += [text[end:a], _MASK]
        end = max(end, b)
    return "".join(out) + text[end:]


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per scanned row: counts of the fixed kinds, their digest, and all spans."""
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        F.col(id_col),
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
