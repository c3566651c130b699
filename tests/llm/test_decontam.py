import hashlib
import random
import re
from collections import defaultdict

import pytest

from assay.llm import decontam

DOCS = "doc_id long, text string, words string, hits int"
ITEMS = "item_id string, text string, hits int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _expected(text, items, window):
    windows = defaultdict(set)
    for item, t in items:
        w = _words(t)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(item)
    words, hit, found = _words(text), set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if owners := windows.get(tuple(words[i : i + size])):
                hit |= set(range(i, i + size))
                found |= owners
    found.discard(None)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, 0 < len(hit) and 20 * len(hit) >= len(words)


def _case():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["ÉTÉ", "x_y", "a-b", "Don't"]
    some = lambda k: " ".join(draw.choices(vocabulary, k=k))
    items = [(f"i{i}", some(draw.randint(1, 30))) for i in range(12)]
    items += [("i3", items[5][1]), ("same", items[2][1]), ("none", "..."), ("null", None), (None, some(20)), ("one", "unique")]
    docs = [some(draw.randint(0, 200)) for _ in range(30)]
    docs += [items[i][1].upper() for i in range(6)] + [f"{some(300)}! {items[4][1]}; {some(300)}" for _ in range(4)]
    docs += [None, "", "?!", "unique", "Unique " * 2000, docs[0], some(60_000)]
    return docs, items


@pytest.mark.parametrize(("window", "block"), [(13, 400_000), (13, 20), (5, 50), (1, 400_000)])
def test_against_brute_force(spark, window, block):
    docs, items = _case()
    rows = spark.createDataFrame([(i, t, "own", 9) for i, t in enumerate(docs)], DOCS)
    scanned = decontam.scan(rows, spark.createDataFrame([(*i, 1) for i in items], ITEMS), window=window, block_windows=block)
    for r in decontam.digest(scanned).collect():
        got = r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]
        assert got == _expected(docs[r["doc_id"]], items, window), r["doc_id"]


def test_documents_go_and_spans_go(spark):
    item = " ".join(f"t{i}" for i in range(13))
    clean = " ".join(f"c{i}" for i in range(400))
    texts = [f"x {item} y", f"{clean}, {item}. End", clean, None, None]
    docs = spark.createDataFrame([(i if i < 4 else None, t, "own", i) for i, t in enumerate(texts)], DOCS)
    items = spark.createDataFrame([("a", item, 0)], ITEMS)
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["hits"] for r in kept.collect()) == [1, 2, 3, 4]
    assert {r["words"] for r in kept.collect()} == {"own"}
    cut = {r["hits"]: r["text"] for r in decontam.remove_spans(docs, items).collect()}
    assert cut == {0: "x y", 1: f"{clean}, End", 2: clean, 3: None, 4: None}


def test_items_without_an_id_and_repeated_items(spark):
    item = " ".join(f"t{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"x {item}", "own", 1)], DOCS)
    unnamed = decontam.digest(decontam.scan(docs, spark.createDataFrame([(None, item, 0)], ITEMS))).first()
    assert (unnamed["n_hit"], unnamed["n_items"], unnamed["contaminated"]) == (13, 0, True)
    assert unnamed["items_sha256"] == hashlib.sha256(b"").hexdigest()
    many = spark.createDataFrame([("a", item, i) for i in range(500)] + [("b", item, 0), (None, item, 0)], ITEMS)
    blocks = list(decontam._blocks(many, "item_id", "text", 13, 400_000))
    assert sorted(blocks[0], key=str) == [("a", item.encode()), ("b", item.encode()), (None, item.encode())]
    assert [h["item"] for h in decontam.scan(docs, many).first()["hits"]] == ["a", "b", None]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "o", 0)], DOCS), spark.createDataFrame([("a", "a b", 0)], ITEMS)
    none = decontam.digest(decontam.scan(docs, items.limit(0))).first()
    assert (none["n_words"], none["n_hit"], none["contaminated"]) == (2, 0, False)
    assert decontam.digest(decontam.scan(docs.limit(0), items)).count() == 0
    with pytest.raises(ValueError, match="window"):
        decontam.scan(docs, items, window=0)
