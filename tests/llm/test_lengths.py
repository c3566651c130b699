import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from assay.llm import lengths

DOCS = "doc_id long, text string, length string, n_docs int"
TEXTS = [None, "", "a", "a", "two words", "<|endoftext|>", "x " * 3000, "naïve 日本  \n\n text"] + [f"{'word ' * (i % 37)}end" for i in range(300)]


def test_every_column_against_the_lengths(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = np.array([len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in TEXTS])
    docs = spark.createDataFrame([(i, t, "own", 2) for i, t in enumerate(TEXTS)], DOCS)
    sums = lengths.with_suffix_sums(lengths.histogram(docs), width=8)
    rows = sums.collect()
    assert sorted(r["length"] for r in rows) == sorted(set(sizes.tolist()))
    for r in rows:
        at = r["length"]
        assert r["n_docs"] == (sizes == at).sum() and r["n_tokens"] == at * r["n_docs"]
        assert r["docs_from"] == (sizes >= at).sum() and r["tokens_from"] == sizes[sizes >= at].sum()
        assert r["docs_over"] == (sizes > at).sum() and r["kept_tokens"] == np.minimum(sizes, at).sum()
        assert abs(r["share_upto"] - (sizes <= at).mean()) < 1e-12
    for r in lengths.at_limits(sums, [0, 5, 17, 100_000]).collect():
        assert r["docs_over"] == (sizes > r["limit"]).sum() and r["kept_tokens"] == np.minimum(sizes, r["limit"]).sum()
    found = lengths.quantiles(sums, {"half": 0.5, "most": 0.9, "all": 1.0}).first()
    ordered = np.sort(sizes)
    assert [found[n] for n in ("half", "most", "all")] == [ordered[int(np.ceil(q * len(sizes))) - 1] for q in (0.5, 0.9, 1.0)]


def test_no_documents_no_rows(spark):
    assert lengths.with_suffix_sums(lengths.histogram(spark.createDataFrame([], DOCS))).count() == 0
