"""The pipeline's stages one after another against brute-force versions, on the smallest tables."""

import corpus_pipeline as P
from loomwork.llm import bpe, toxicity
from loomwork.llm.common import cut, table
from loomwork.llm.labelled import fold

from .test_operators import SF, brute_fp, brute_groups, brute_lines, leaks_by_hand, sha


def test_pipeline(spark):
    assert [k for k, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"] and P.ORACLE_SQL is None
    docs, texts = table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = cut(stage(spark, docs, SF), f"test-{k}")
        texts.append({r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()} if k < 4 else None)
        assert k == 4 or docs.columns == table(spark, SF, "documents").columns
    raw = table(spark, SF, "documents")
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(raw, *toxicity.train(raw, table(spark, SF, "labels"), fold("doc_id", 4) != 2)).collect()}
    assert set(texts[0]) == {i for i, s in score.items() if s < toxicity.CUTOFF}
    assert texts[1] == {i: t for i, (_, t) in brute_lines(texts[0].items()).items()}
    assert set(texts[2]) == set(brute_groups([(i, brute_fp(t)) for i, t in texts[1].items()]).values())
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert set(texts[3]) == {i for i, t in texts[2].items() if not leaks_by_hand(items, t)}
    coder = bpe.ForcedBPE(bpe.spec_of(bpe.tokenizer_path()))
    assert {r["doc_id"]: r["ids_sha256"] for r in docs.collect()} == {i: sha(" ".join(map(str, coder.encode(t)))) for i, t in texts[3].items()}
    assert {r["doc_id"] for r in P.run(spark, SF).collect()} == set(texts[3])
