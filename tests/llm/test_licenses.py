import os
import textwrap

import duckdb
import pandas as pd
import pytest

from assay.llm import licenses

TEXTS = "/usr/share/common-licenses"
DOCS = "doc_id long, text string, license string, notices int"
MIT, ISC = licenses.KNOWN[1][1], next(t for n, t in licenses.KNOWN if n == "ISC")


def _found(spark, texts):
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(texts)], DOCS)
    return {r["doc_id"]: r for r in licenses.scan(docs).collect()}


def test_whole_texts_in_other_dress(spark):
    wrapped = "\n".join(" * " + x for x in textwrap.wrap(MIT, 60))
    variants = [
        MIT,
        MIT.upper(),
        wrapped,
        "Copyright (c) 2019-2024 A. Person, licence holders\nCopyright 2020 Some Body\nAll rights reserved.\n\n" + wrapped,
        MIT.replace("License", "Licence").replace("sublicense", "sub-licence").replace('"', "“"),
        ISC.replace(", ", " ,\n"),
    ]
    found = _found(spark, [*variants, MIT + " Also, a term of our own.", MIT.replace("free of charge", "for a fee")])
    assert [found[i]["license"] for i in range(8)] == ["MIT"] * 5 + ["ISC", None, None]
    assert len({found[i]["text_sha256"] for i in range(5)}) == 1


def test_notices_are_whole_lines(spark):
    found = _found(spark, ["prose\nReleased under the MIT Licence!\nmore\nLICENSED UNDER CC-BY 4.0", "prose. Released under the MIT License.", "Released under the MIT License."])
    assert [found[i]["notices"] for i in range(3)] == ["CC-BY-4.0,MIT", "", "MIT"]
    assert [found[i]["license"] for i in range(3)] == [None, None, "MIT"]


def test_nulls_repeats_and_long_texts(spark):
    texts = [None, "", " ?!\n", "Copyright 2024 X", "word " * 200_000]
    found = _found(spark, texts)
    assert len({found[i]["text_sha256"] for i in range(4)}) == 1 and all(r["license"] is None and r["notices"] == "" for r in found.values())
    rows = [(None, "Released under the MIT License.", None, None)] * 2 + [(5, "x", None, None)] * 2
    out = licenses.scan(spark.createDataFrame(rows, DOCS))
    assert sorted((str(r["doc_id"]), r["notices"]) for r in out.collect()) == [("5", ""), ("5", ""), ("None", "MIT"), ("None", "MIT")]
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_the_plan_stays_in_the_engine(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "a", "", 0)], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.skipif(not os.path.isdir(TEXTS), reason="no licence texts")
def test_full_texts_of_longer_licences(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1"}
    files |= {"LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3"}
    files = {n: f for n, f in files.items() if os.path.isfile(f"{TEXTS}/{f}")}
    texts = [open(f"{TEXTS}/{f}", encoding="utf-8").read() for f in files.values()]
    end = "END OF TERMS AND CONDITIONS"
    short = [(n, t.partition(end)[0] + end) for n, t in zip(files, texts) if end in t]
    found = _found(spark, [*texts, *(" ".join(t.upper().split(" ")) for t in texts), *(t for _, t in short), texts[0] + " more"])
    assert [found[i]["license"] for i in range(len(found))] == [*files, *files, *(n for n, _ in short), None]


@pytest.mark.skipif(not os.path.isfile(f"{TEXTS}/GPL-3"), reason="no licence texts")
def test_full_texts_equal_the_oracle(spark):
    texts = [open(f"{TEXTS}/{f}", encoding="utf-8").read() for f in ("GPL-3", "Apache-2.0") if os.path.isfile(f"{TEXTS}/{f}")]
    documents = pd.DataFrame({"doc_id": range(len(texts) + 2), "text": [*texts, MIT, "Released under the MIT License."]})  # noqa: F841
    expected = duckdb.sql(licenses.ORACLE).fetchall()
    found = _found(spark, list(documents["text"])).values()
    assert sorted(map(tuple, found)) == sorted(expected) and sorted(expected)[0][2] == "GPL-3.0"
