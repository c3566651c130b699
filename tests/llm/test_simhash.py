import random
import re

import numpy as np
import pytest
import xxhash

from assay.llm import simhash
from assay.llm.components import components

SCHEMA = "doc_id long, text string, fp string, id int"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _near(values, budget):
    a = np.array(values, np.int64)
    out = set()
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count((a[i + 1 :] ^ a[i]).view(np.uint64)) <= budget):
            out.add((int(min(a[i], a[i + 1 + j])), int(max(a[i], a[i + 1 + j]))))
    return out


def _texts():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Äb", "é x", "Ünd"]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 80))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "One TWO", "one two"]
    long = draw.choices(words, k=900)
    for i in range(25):
        copy = list(long)
        copy[draw.randrange(900)] = f"edit{i}"
        texts.append("  ".join(copy))
    return texts + texts[:8] + ["word " * 70_000]


def test_every_row_against_brute_force(spark):
    texts = _texts()
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(4, texts[4], "x", 3)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    prints = {i: _fingerprint(t) for i, t in enumerate(texts)}
    ids = sorted(prints)
    pairs = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = _classes(pairs, ids)
    for r in found:
        assert int(r["fingerprint"], 16) == prints[r["doc_id"]] and len(r["fingerprint"]) == 16
        assert r["component_id"] == expected[r["doc_id"]]


@pytest.mark.parametrize(("leaf", "budget"), [(4096, 2), (8, 2), (2, 2), (16, 3), (4096, 1), (16, 0)])
def test_trie_finds_every_link_once(spark, leaf, budget):
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1]
    values = set(base)
    for b in base[-4:]:
        for _ in range(120):
            x = b
            for _ in range(draw.randint(0, 4)):
                x ^= 1 << draw.randrange(64)
            values.add(x)
    values = [_signed(x) for x in sorted(values)]
    links = simhash.trie_links(spark.createDataFrame([(x,) for x in values], "fp long"), leaf=leaf, budget=budget)
    found = [(r["a"], r["b"]) for r in links.collect()]
    assert len(found) == len(set(found)) and set(found) == _near(values, budget)


def test_components_of_chains_stars_and_rings(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    draw.shuffle(links)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == _classes(links, {n for p in links for n in p})


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c d", "x", 1), (None, "a b c d", "x", 1), (7, "a b c d", "x", 2), (None, "z y", "x", 1)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r["component_id"]) for r in found) == ["7", "7", "7", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "x", 1), (2, "a b c d", "x", 2), (3, "q r s", None, None), (None, None, None, 4)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "id"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
