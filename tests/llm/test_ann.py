import numpy as np
import pytest

from assay.llm import ann

SCHEMA = "vec_id long, embedding array<float>, id int, code string"


def _rows():
    draw = np.random.default_rng(8)
    centres = draw.standard_normal((6, 24))
    vectors = (centres[draw.integers(0, 6, 900)] + 0.5 * draw.standard_normal((900, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[7].tolist()) for i in range(150)]  # one vector many times
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 24, [nan] + [1.0] * 23, [inf] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 5]
    return rows + [(2000 + i, v) for i, v in enumerate(bad)] + [(None, vectors[3].tolist())]


def _expected(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and i < 2000]
    out = set()
    for q, a in good:
        if q % 20 == 0:
            scored = [(-float(np.add.accumulate(a * b)[-1]), i) for i, b in good if i != q]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize(("block", "slice_rows"), [(4096, 8192), (10, 100)])
def test_neighbours_against_brute_force(spark, block, slice_rows):
    rows = _rows()
    index = ann.index(spark.createDataFrame([(*r, 5, "own") for r in rows], SCHEMA))
    assert index.rows.count() == 1050
    asked = index.rows.filter("id % 20 = 0")
    found = {tuple(r) for r in ann.search(index, asked, block=block, slice_rows=slice_rows).collect()}
    expected = _expected(rows, 20)
    assert len(found) == len(expected) and len(found & expected) >= 0.99 * len(expected)


def test_estimates_lie_within_their_bounds():
    draw = np.random.default_rng(9)
    vectors, queries = draw.standard_normal((2000, 64)) + 0.3, draw.standard_normal((50, 64))
    mean, turn = vectors.mean(axis=0), ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    code, length, cosine = ann.encode(vectors, mean, turn)
    assert code.shape == (2000, 8)
    signs = (np.unpackbits(code, axis=1) * 2.0 - 1) / 8
    estimate = (queries @ turn) @ signs.T * (length / cosine) + (queries @ mean)[:, None]
    error = np.abs(estimate - queries @ vectors.T)
    bound = np.linalg.norm(queries, axis=1)[:, None] * length * np.sqrt(1 - cosine**2) / cosine * ann.EPSILON / np.sqrt(63)
    assert (error > bound).mean() < 0.01
    assert abs((estimate - queries @ vectors.T).mean()) < 0.1


def test_few_rows_and_none(spark):
    few = ann.index(spark.createDataFrame([(20, [1.0, 2.0], 0, ""), (21, [0.5, 1.0], 0, ""), (21, [0.5, 1.0], 0, "")], SCHEMA))
    found = ann.search(few, few.rows.filter("id = 20")).collect()
    assert [tuple(r) for r in found] == [(20, 1, 21, 2.5), (20, 2, 21, 2.5)]
    none = ann.index(spark.createDataFrame([], SCHEMA))
    assert ann.search(none, none.rows).count() == 0
