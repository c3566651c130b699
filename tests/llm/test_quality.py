import itertools
import math
import random

import numpy as np
import pytest

from assay.llm import quality

DOCS = "doc_id long, text string, score string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def _text(draw, good):
    words = "river stone letter window morning paper garden table yellow quiet answer north".split()
    lines = []
    for _ in range(draw.randint(1, 9)):
        some = draw.choices(words, k=draw.randint(4, 30))
        lines.append(" ".join(some).capitalize() + "." if good else " ".join(w + draw.choice(("###", "%%%", "***")) for w in some))
    return "\n".join(lines)


def _tables(spark, n=400):
    draw = random.Random(12)
    marks = [draw.random() < 0.7 for _ in range(n)]
    rows = [(i, _text(draw, good), "own", "en") for i, good in enumerate(marks)]
    extra = [(n, None, None, None), (n + 1, "", None, None), (None, "Some words here.", None, None), (5, rows[5][1], "own", "en"), (n + 2, "Word " * 50_000, None, None)]
    labels = [(i, int(good), 0) for i, good in enumerate(marks)] + [(None, 1, 1), (3, None, 0), (9, int(marks[9]), 1)]
    return spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame(labels, LABELS), marks


def test_held_out_documents_are_told_apart(spark):
    docs, labels, marks = _tables(spark)
    rows = quality.score(docs, labels).collect()
    assert len(rows) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 50
    good = [r["score"] for r in held if marks[r["doc_id"]]]
    bad = [r["score"] for r in held if not marks[r["doc_id"]]]
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    assert not next(r for r in rows if r["doc_id"] is None)["held_out"]


def test_without_labels_or_documents(spark):
    docs, labels, _ = _tables(spark, 30)
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.score(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality.score(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("length", [1, 2, 5])
def test_marginals_against_enumeration(length):
    draw = np.random.default_rng(length)
    odds, links = draw.normal(size=length), draw.normal(size=(2, 2))
    total, good, pairs = 0.0, np.zeros(length), np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=length):
        w = math.exp(sum(o for o, y in zip(odds, labels) if y) + sum(links[a][b] for a, b in itertools.pairwise(labels)))
        total += w
        good += w * np.array(labels)
        for a, b in itertools.pairwise(labels):
            pairs[a][b] += w
    found, expected, log_total = quality.marginals(odds.tolist(), links.tolist())
    assert np.allclose(found, good / total) and np.allclose(expected, pairs / total) and np.isclose(log_total, math.log(total))


def test_a_line_is_read_with_its_neighbours():
    x, lengths = quality.line_features("One.\n\nthree###\nOne.")
    assert lengths.tolist() == [4, 0, 8, 4] and x.shape == (4, quality.WIDTH)
    own = quality.OWN
    assert np.array_equal(x[1, own : 2 * own], x[0, :own]) and np.array_equal(x[1, 2 * own : 3 * own], x[2, :own])
    assert not x[0, own : 2 * own].any() and not x[3, 2 * own : 3 * own].any()


def test_line_labels_number_the_lines(spark):
    docs, labels, _ = _tables(spark, 60)
    field = quality.fit(docs, labels)
    lines = quality.line_labels(docs.filter("doc_id = 7"), field).collect()
    text = docs.filter("doc_id = 7").first()["text"]
    assert [r["line"] for r in sorted(lines, key=lambda r: r["line"])] == list(range(text.count("\n") + 1))
