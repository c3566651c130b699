import pyarrow as pa

from assay.llm.tables import portions


def test_portions_hold_every_row_once_and_little_text():
    texts = ["x" * 10, None, "y" * 500, "", "z" * 2000] + ["w" * 30] * 40
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    parts = list(portions(iter([batch.slice(0, 0), batch, batch.slice(3, 5)]), "text", rows=7, size=600))
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["text"] for r in rows] == texts + texts[3:8]
    for p in parts:
        held = sum(len(t or "") for t in p.column("text").to_pylist())
        assert 0 < p.num_rows <= 7 and (held <= 600 or p.num_rows == 1)
