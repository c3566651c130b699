import random
import re

import numpy as np
import pyarrow as pa
import pytest

from assay.llm import minhash

SCHEMA = "doc_id long, text string, node long, size int, a string, key string"


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _set(text, words=3):
    found = _words(text)
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} or ({tuple(found)} if found else set())


def _components(sets, near=(17, 20)):
    """Smallest index reachable, over all pairs."""
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and len(x & sets[j]) * near[1] >= len(x | sets[j]) * near[0]:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(sets))]


def _edited(draw, words, edits, name):
    out = list(words)
    for k in range(edits):
        out[draw.randrange(len(out))] = f"{name}e{k}"
    return " ".join(out)


def _texts(seed=7):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Äb", "É", "ünD", "x y", "\xa0"]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "One TWO", "one two", "ONE  two\tThree", "one two three"]
    base = draw.choices(vocabulary, k=120)
    texts += [_edited(draw, base, draw.randint(0, 9), f"n{i}") for i in range(70)]  # one large group of near copies
    passage = draw.choices(vocabulary, k=40)
    texts += [" ".join([*draw.choices(vocabulary, k=draw.randint(3, 60)), *passage]) for _ in range(60)]
    chain = draw.choices(vocabulary, k=80)
    for i in range(12):  # each near to the next alone
        texts.append(" ".join(chain))
        chain[5 * i] = f"c{i}"
    return texts + texts[:6] + ["lorem ipsum " * 60_000, "x" * 300_000]


def test_sets_of_shingles_are_those_of_plain_python():
    texts = [*_texts(), "a\x00b c", "\x0b\x0c", "a b c a b c a b c"]
    for words in (1, 3, 5):
        for cut in (slice(None), slice(3, None, None)):
            some = pa.array(texts)[cut]
            found, ends = minhash.shingle_sets(some, words)
            names = {}
            for text, own in zip(some.to_pylist(), np.split(found, ends[:-1])):
                expected = _set(text, words)
                assert len(own) == len(expected) and (np.diff(own.astype(object)) > 0).all()
                key = frozenset(expected)
                assert names.setdefault(key, own.tobytes()) == own.tobytes()
            assert len(set(names.values())) == len(names)


def test_pairs_just_near_share_a_table():
    for near in ((17, 20), (4, 5)):
        j, m = near[0] / near[1], minhash.groups(near)
        assert 1 - (1 - (1 - j**minhash.ROWS) ** m) ** 2 <= minhash.MISS


def test_minhashes_agree_as_often_as_sets(spark):
    texts = [" ".join(f"s{i}" for i in range(k, k + 1000)) for k in (0, 100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    x, y = minhash.sketches(rows, words=1, m=400, each=1).orderBy("id").collect()
    share = np.mean([p == q for p, q in zip([*x["a"], *x["b"]], [*y["a"], *y["b"]])])
    assert abs(share - 900 / 1100) < 0.05


@pytest.mark.parametrize(("crowd", "half", "words", "near"), [(16, 50_000, 3, (17, 20)), (3, 20, 3, (17, 20)), (8, 50_000, 5, (4, 5))])
def test_every_row_against_all_pairs(spark, crowd, half, words, near):
    texts = _texts()
    expected = _components([_set(t, words) for t in texts], near)
    rows = [(i, t, 1, 2, "p", "q") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r for r in minhash.near_copies(table, crowd=crowd, half=half, words=words, near=near).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert found[i]["n_shingles"] == len(_set(text, words))
        assert found[i]["component_id"] == expected[i], (i, text and text[:50])
        assert found[i]["kept"] == (expected[i] == i)


def test_large_groups_make_few_pairs(spark):
    """One group of near copies and one common passage: candidates grow with the rows."""
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, passage = draw.choices(vocabulary, k=150), draw.choices(vocabulary, k=40)
    made = {}
    for n in (100, 400):
        texts = [" ".join(base)] + [_edited(draw, base, draw.randint(0, 9), f"n{i}") for i in range(n)]
        texts += [" ".join([*draw.choices(vocabulary, k=draw.randint(20, 60)), *passage]) for _ in range(n)]
        rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        pairs = []
        plain = minhash.compared

        def counted(some, *args, **options):
            pairs.append(some.count())
            return plain(some, *args, **options)

        minhash.compared = counted
        try:
            links = minhash.near_links(rows)[2].count()
        finally:
            minhash.compared = plain
        made[n] = (sum(pairs), links)
    assert made[400][0] <= 6 * made[100][0] and made[400][0] <= 4 * 800 and made[400][1] <= 4 * 800


def test_null_ids_ties_and_empty_tables(spark):
    rows = [(None, "a b c d", 1, 2, "p", "q"), (None, "a b c d", 1, 2, "p", "q"), (7, "a b c d", 1, 2, "p", "q"), (None, "z y", 1, 2, "p", "q")]
    rows += [(7, "a b c d", 1, 2, "p", "q"), (7, "other text of it", 1, 2, "p", "q")]
    found = minhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in found) == sorted(
        [("None", "7", False)] * 2 + [("7", "7", True)] * 3 + [("None", "None", True)]
    )
    assert minhash.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert minhash.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_document_of_each_group_stays(spark):
    texts = ["a b c d e f g", "A b c d e f g", "other words here", "", None, " "]
    rows = [(9 - i, t, 1, 2, "p", "q") for i, t in enumerate(texts)] + [(None, "a b c d e f g", 1, 2, "p", "q")]
    kept = minhash.drop_near_copies(spark.createDataFrame(rows, SCHEMA), words=5, near=(4, 5))
    assert kept.columns == ["doc_id", "text", "node", "size", "a", "key"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "7", "8", "None"]
