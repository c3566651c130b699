import hashlib
import random
import zlib

import pytest

from assay.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, hash string, pos long, path string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _tree(leaves):
    """(levels, path of each leaf as (left, right) steps), a level at a time."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(leaves)):
        steps = []
        for level in levels[:-1]:
            run = i - i % 3
            steps.append((level[run:i], level[i + 1 : run + 3]))
            i //= 3
        paths.append(steps)
    return levels, paths


def _expected(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    grouped = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for s in sources]
    trees = [_tree([_leaf(r) for r in g]) for g in grouped]
    levels, tops = _tree([t[0][-1][0] for t in trees])
    root, out = levels[-1][0], []
    for g, (own, paths), top in zip(grouped, trees, tops):
        for row, path in zip(g, paths):
            node = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                node = (*row[:4], row[4].replace("\n", ""))
            node, proof = _leaf(node), ""
            for left, right in [*path, *top]:
                node = _h(*left, node, *right)
                proof += "".join([*left, *right])
            out.append((row[0], _leaf(row), own[-1][0], root, _h(proof), node, node == root))
    return out


def _rows(n, seed=3):
    draw = random.Random(seed)
    sources = [None, "", "web", "é", "ﬀ", "𐐀", "z", *[f"s{i}" for i in range(9)], *["hot"] * 12]
    rows = [
        (i, draw.choice(sources), draw.choice([None, "en", "de"]), draw.choice([None, i]), draw.choice([None, "", "a\nb", "ä\n" * i, "x"]))
        for i in draw.sample(range(10 * n), n)
    ]
    rows += rows[:2] + [(None, "hot", "en", 1, "no id\n"), (None, "hot", "en", 1, "no id\n"), (None, None, None, None, None), (5 * 10**9, "lone", "en", 9, "y\n" * 200_000)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "every", "buckets"), [(400, 4, 16), (150, 1, 4), (30, 3, 1)])
def test_every_row_against_whole_trees(spark, n, every, buckets):
    rows = _rows(n)
    table = spark.createDataFrame([(*r, 1, "x", 2, "p") for r in rows], SCHEMA)
    found = merkle.digest(merkle.audit(table, every=every, buckets=buckets))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(_expected(rows), key=key)


def test_only_every_few_levels_are_stored(spark):
    table = spark.createDataFrame([(i, "one", "en", 1, str(i), 1, "x", 2, "p") for i in range(300)], SCHEMA)
    built = merkle.manifest(table, every=2)
    assert [level.count() for level in built.levels] == [300, 34, 4]
    assert merkle.proofs(built).selectExpr("max(size(path))").first()[0] == 6


def test_lone_rows_and_empty_tables(spark):
    one = spark.createDataFrame([(7, "a", None, None, "t", 1, "x", 2, "p")], SCHEMA)
    row = merkle.audit(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["path"] == []
    assert row["proof_sha256"] == _h("") and row["verified"]
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0
