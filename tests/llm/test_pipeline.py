"""The pipeline's stages against brute force on a small corpus."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import test_decontaminate
import test_ngram_join

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as P
    from sheetwise.llm.common import written
    from sheetwise.llm.registry import tokenizer_path
    from tokenizers import Tokenizer
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34 !!", None, "s", 8), (9003, " ", "fr", None, None)],
                                given.schema)
    docs = written(given.unionByName(odd), "t")
    rows = {r.doc_id: r.text for r in docs.collect()}

    stages = dict(P.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_jaccard_join", "decontamination", "bpe"]
    kept = written(stages["language_id"](spark, docs, SF), "t")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(rows) - {9001, 9002, 9003}

    once = written(stages["exact_dedup"](spark, kept, SF), "t")
    groups = {}
    for r in kept.collect():
        groups.setdefault("".join(r.text.split()), []).append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in once.collect()) == sorted(min(g)[1] for g in groups.values())

    apart = written(stages["ngram_jaccard_join"](spark, once, SF), "t")
    pairs = [(r.doc_id, r.text) for r in once.collect()]
    want = sorted(d for d, _, c in test_ngram_join.brute(pairs, 5, 4, 5) if c == d)
    assert sorted(r.doc_id for r in apart.collect()) == want and len(want) < len(pairs)

    clean = written(stages["decontamination"](spark, apart, SF), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(r.doc_id for r in apart.collect() if not test_decontaminate.brute(items, r.text))
    assert sorted(r.doc_id for r in clean.collect()) == want

    last = stages["bpe"](spark, clean, SF).collect()
    lib = Tokenizer.from_file(tokenizer_path())
    assert sorted(r.doc_id for r in last) == want
    assert all(r.round_trip and r.ids == lib.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
               for r in last)
    assert sorted(r.doc_id for r in P.run(spark, SF).collect()) == sorted(
        r.doc_id for r in P.token_stage(spark, P.benchmark_stage(spark, P.near_stage(spark, P.exact_stage(
            spark, P.language_stage(spark, given, SF), SF), SF), SF), SF).collect())
