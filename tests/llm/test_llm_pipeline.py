"""The pipeline's stages, one after the other, against plain Python and the operators' own results."""

import corpus_pipeline
from opsframe.llm import pii, simhash
from opsframe.llm.common import table, written

from test_llm_operators import check_bins, dedup_lines


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "personal_data", "best_fit_packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir))
        seen.append(docs)
        if name != names[-1]:
            assert docs.schema == seen[0].schema
    text = [{r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for df in seen[:-1]]
    assert set(text[1]) <= set(text[0]) and all(text[0][i] == t for i, t in text[1].items())
    assert text[2] == dict(dedup_lines(sorted(text[1].items())))
    first = {r["component_id"] for r in simhash.near_duplicates(seen[2]).collect()}
    assert set(text[3]) == first and all(text[2][i] == t for i, t in text[3].items())
    assert text[4] == {i: pii.mask(t) for i, t in text[3].items()}
    packed = docs.collect()
    check_bins(packed, 2048, [])
    whole = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["piece"])):
        whole[r["doc_id"]] = whole.get(r["doc_id"], "") + r["text"]
    assert whole == text[4]


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
