import zlib

import numpy as np

import corpus_pipeline
from marketlake.llm import decontaminate, mixing, simhash, tokenbin
from marketlake.llm.common import table, write_shared

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    """Each stage on what the one before it kept: columns stay, rows only go, and the last stage encodes what is left."""
    docs = table(spark, SF, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.read.parquet(write_shared(stage(spark, docs, SF), name))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before
        kept.append(len(after))
        docs = out
        if name == "simhash_near_dedup":
            groups = simhash.near_copies(docs)
            assert groups.count() == groups.select("component_id").distinct().count()
        if name == "benchmark_decontamination":
            again = decontaminate.find_contamination(docs, table(spark, SF, "benchmark"))
            left = again.where("size(contamination.spans) > 0").count()
            assert left == 0
    assert kept[0] > 180 and kept[1] > 150 and kept[2] == kept[1]
    library = tokenbin.Encoder(tokenbin.vocabulary_file()).library
    start, want = 0, []
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = library.encode(r["text"], add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r) for r in whole.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    # what a run leaves: every id, from the files alone
    left = {r["doc_id"]: list(r["ids"]) for r in tokenbin.read_tokens(spark, corpus_pipeline.token_files(spark), with_ids=True).collect()}
    assert left == {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids + [2] for r in docs.collect()}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    assert corpus_pipeline.ORACLE_SQL is None and mixing.ROUNDS >= 24
