import random

import corpus_pipeline
from assay.llm import minhash, simhash

SCHEMA = "doc_id long, text string, lang string"


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]


def texts():
    line, tail, other = words(1, 13), words(2, 80), words(3, 80)
    return {1: line * 300 + tail, 2: line * 300 + other, 3: line + other, 4: words(4, 200)}


def kept(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stage_joins_fingerprints_and_sets(spark):
    rows = {i: " ".join(w) for i, w in texts().items()}
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows.items()], SCHEMA)
    bits = {i: simhash.fingerprint(t.encode().split(), 3) for i, t in rows.items()}
    apart = lambda i, j: ((bits[i] ^ bits[j]) & (2**64 - 1)).bit_count()
    assert apart(1, 2) <= 2 < min(apart(2, 3), apart(1, 3))  # 1 and 2 are near by fingerprints alone
    assert [i for i, _ in kept(minhash.drop_near_copies(docs, words=5, near=(4, 5)))] == [1, 2, 4]  # 2 and 3 by sets
    # 3 goes with 2, which goes with 1: links of both make one component.
    assert kept(corpus_pipeline.near_dedup_stage(spark, docs, "")) == [(1, rows[1]), (4, rows[4])]


def test_texts_under_one_id_are_rows_of_their_own(spark):
    one, two, three = (" ".join(words(i, 60)) for i in (11, 12, 13))
    rows = [(5, one, "en"), (5, two, "en"), (5, two, "fr"), (3, two, "en"), (8, one, "en"), (5, one, "fr"), (9, three, "en"), (None, one, "en"), (6, None, "en"), (7, " ", "en")]
    found = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").select("doc_id", "text").collect()
    # 5 names the component of `one`, and its other text goes with 3.
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [(3, two), (5, one), (6, None), (9, three), (None, one)]))


def test_empty(spark):
    assert corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
