import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assay.llm import packing

DOCS = "doc_id long, text string, start long, ids string"


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def _texts():
    draw = np.random.default_rng(4)
    words = [f"word{i}" for i in range(200)] + ["<|endoftext|>", "\n\n", "naïve", "日本", "'ll", "  "]
    texts = [" ".join(draw.choice(words, draw.integers(1, 900))) for _ in range(120)]
    return [*texts, None, "", " ", texts[0], "long " * 20_000, "a" * 30_000]


@pytest.mark.parametrize(("window", "shard"), [(2048, 1024), (64, 7), (1, 3)])
def test_every_id_lies_in_one_piece(spark, encode, window, shard):
    texts = _texts() if window > 1 else ["a b", None, "c"]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], DOCS).repartition(3)
    rows = packing.pack(docs, window=window, shard=shard).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        ids = [x for r in pieces for x in np.frombuffer(r["ids"], "<u4").tolist()]
        assert ids == encode(text)
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in pieces])
        assert [r["offset"] for r in pieces] == [0, *ends[:-1].tolist()]
        assert ends[-1] == window or ends[-1] < window and ends[-1] & (ends[-1] - 1) == 0


def test_digest_is_the_crc_of_the_ids(spark):
    docs = spark.createDataFrame([(1, "some words here", 0, "x")], DOCS)
    piece, digest = packing.pack(docs).first(), packing.digest(packing.pack(docs)).first()
    assert digest["ids_crc32"] == zlib.crc32(piece["ids"]) and digest["sequence_id"] == piece["sequence_id"]


def test_neighbours_are_the_best_by_bm25():
    docs = [np.array(x, np.uint16) for x in ([1, 2, 3], [7, 8], [2, 3, 9], [2, 5, 5, 5, 5, 6])]
    index = packing.Index(docs)
    n, mean = len(docs), np.mean([len(d) for d in docs])

    def score(query, doc):
        total = 0.0
        for t in set(query.tolist()):
            df = sum(t in d for d in docs)
            tf = int((doc == t).sum())
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        return total

    found = index.neighbours(0, np.array([False, True, True, True]))
    expected = sorted((i for i in (1, 2, 3) if score(docs[0], docs[i]) > 0), key=lambda i: -score(docs[0], docs[i]))
    assert found.tolist() == expected == [2, 3]


def test_repeated_and_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b", 0, "x"), (3, "c", 0, "x"), (3, "c", 0, "x")], DOCS).coalesce(1)
    rows = packing.pack(docs).collect()
    assert sum(r["length"] for r in rows) == sum(r["length"] for r in packing.pack(docs).collect()) == 7
    assert packing.digest(packing.pack(docs.limit(0))).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, window=100)


def test_all_terms_of_a_long_seed_count():
    seed, rare = np.arange(100, 150), np.arange(100, 124)
    docs = [seed, np.arange(124, 150), np.append(rare[:1], np.arange(300, 325)), np.arange(124, 130)]
    docs += [np.append(np.arange(124, 150), 1000 + i) for i in range(6)]
    index = packing.Index([d.astype(np.uint16) for d in docs])
    others = np.arange(len(docs)) > 0
    assert index.neighbours(0, others)[0] == 1
    # 26 terms that nobody else has, and one that another document shares.
    alone = packing.Index([np.arange(10, 37).astype(np.uint16), np.array([36, 50], np.uint16), np.array([51], np.uint16)])
    assert alone.neighbours(0, np.array([False, True, True])).tolist() == [1]
    assert packing.Index([np.array([1], np.uint16), np.array([2], np.uint16)]).neighbours(0, np.array([False, True])).size == 0


def _topics():
    draw = np.random.default_rng(6)
    topics = [["".join(draw.choice(list("abdefgiklmnoprstuvz"), 6)) for _ in range(30)] for _ in range(20)]
    common = [f"common{i}" for i in range(50)]
    return [(i, i % 20, " ".join([*draw.choice(topics[i % 20], 25), *draw.choice(common, 25)])) for i in range(1200)]


def test_statistics_are_of_all_pieces_of_the_table(spark, encode):
    texts = [*_texts()[:40], None, "long " * 3000]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], DOCS).repartition(7)
    parts = packing.pieces(docs, id_col="doc_id", text_col="text", path=packing.vocabulary(), window=256, end=1)
    known = packing.statistics(parts)
    units = [ids[at : at + 256] for ids in map(encode, texts) for at in range(0, len(ids), 256)]
    assert known.mean == pytest.approx(np.mean([len(u) for u in units]))
    for term in {x for u in units for x in u}:
        df = sum(term in u for u in units)
        assert known.idf[term] == pytest.approx(np.log(1 + (len(units) - df + 0.5) / (df + 0.5)), rel=1e-6)
    none = packing.statistics(parts.limit(0))
    assert none.mean == 0 and len(none.idf) == 1


def test_documents_of_one_topic_meet_wherever_they_lie(spark):
    rows = _topics()
    docs = spark.createDataFrame([(i, t, 5, "x") for i, _, t in rows], DOCS).repartition(9)
    topic = {i: t for i, t, _ in rows}
    together = {}
    for r in packing.pack(docs, shard=64).collect():
        together.setdefault(r["sequence_id"], []).append(topic[r["doc_id"]])
    same = [np.mean([a == b for b in got]) for got in together.values() if len(got) > 3 for a in got]
    assert np.mean(same) > 0.6  # one in twenty by chance


def test_leaders_order_a_table_alike_and_copies_are_parted(spark):
    rows = [(i, "one text that many documents copy", 5, "x") for i in range(500)]
    docs = spark.createDataFrame(rows + [(500 + i, t, 5, "x") for i, _, t in _topics()], DOCS).repartition(5)
    parts = packing.pieces(docs, id_col="doc_id", text_col="text", path=packing.vocabulary(), window=2048, end=1)
    known = packing.statistics(parts)
    lead = packing.leaders(parts, known)
    assert lead.size == packing.LEADERS
    rests = packing.ordered(parts.drop("sequence_id"), lead, 8).withColumn("task", F.spark_partition_id()).collect()
    keys = {r["id"]: r["place"] // packing.PLACES for r in rests}
    assert len({keys[i] for i in range(500)}) == 1 and len(set(keys.values())) > 600
    ranges = {}
    for r in rests:
        ranges.setdefault(r["task"], []).append(r["place"])
    assert len(ranges) == 8 and max(map(len, ranges.values())) < 300
    spans = sorted((places[0], places[-1]) for places in ranges.values() if places == sorted(places))
    assert len(spans) == 8 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    # A piece that shares nothing with any leader has a key, too.
    assert lead.key(np.flatnonzero(lead.slot < 0)[:3]) > 0
    assert packing.Leaders([], known).key(np.array([5], np.uint16)) == 0
