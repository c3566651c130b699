import random

import pytest

from assay.llm import toxicity

DOCS = "doc_id long, text string, score string, x int"
LABELS = "doc_id long, toxic int, quality int"


def _tables(spark, n=600):
    draw = random.Random(21)
    words = "river stone letter window morning paper garden table yellow quiet answer north".split()
    rows, marks = [], []
    for i in range(n):
        text = draw.choices(words, k=draw.randint(5, 120))
        marks.append(draw.random() < 0.25)
        if marks[-1]:  # a made-up stem with endings, which only labels can teach
            for _ in range(draw.randint(2, 5)):
                text.insert(draw.randrange(len(text)), "zorbl" + draw.choice(("ig", "en", "ung", "heit")))
        rows.append((i, " ".join(text).capitalize() + ".", "own", 1))
    extra = [(n, None, None, None), (n + 1, "", None, None), (None, "river", None, None), (4, rows[4][1], "own", 1), (n + 2, "stone " * 50_000, None, None)]
    labels = [(i, int(t), 0) for i, t in enumerate(marks)] + [(None, 1, 1), (3, None, 0), (9, int(marks[9]), 1)]
    return spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame(labels, LABELS), marks


@pytest.fixture(scope="module")
def case(spark):
    docs, labels, marks = _tables(spark)
    return docs, labels, marks, toxicity.fit(docs, labels, rounds=8)


def test_held_out_documents_are_told_apart(spark, case):
    docs, _, marks, scorer = case
    rows = scorer.scores(docs.withColumn("held", toxicity.held_out("doc_id")), keep=["doc_id", "held"]).collect()
    assert len(rows) == 605 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held"] and r["doc_id"] < 600]
    assert len(held) > 100
    assert all((r["score"] >= 0.3) == marks[r["doc_id"]] for r in held)
    assert not next(r for r in rows if r["doc_id"] is None)["held"]


def test_rejected_documents_go_and_columns_stay(spark, case):
    docs, _, marks, scorer = case
    kept = scorer.below(docs, 0.3)
    assert kept.columns == docs.columns
    found = kept.filter("doc_id < 600 OR doc_id IS NULL").collect()
    assert len(found) == sum(not m for m in marks) + 1 + (not marks[4])


def test_without_both_labels_or_documents(spark, case):
    docs, labels, _, _ = case
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, labels.filter("toxic = 1")).collect()} == {1.0}
    rows = toxicity.score(docs.limit(0), labels)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == 0


def test_features_by_hand():
    lexicon = toxicity.Lexicon({"zorbl*": 4.0, "scum": 5.0})
    x = dict(zip(toxicity.NAMES, toxicity.features("YOU zorblig! Read on and on and sc0um, id1ot", lexicon)))
    assert x["hits"] == 1 and x["near_second"] == 1 and x["distinct"] == 1 and x["strongest"] == 4.0
    assert x["obfuscated_hits"] == 1 and x["capitals"] == pytest.approx(4 / 32)
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon) == [0.0] * len(toxicity.NAMES)
    assert len(toxicity.features("?!", lexicon)) == len(toxicity.NAMES)
