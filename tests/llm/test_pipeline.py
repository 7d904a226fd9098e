"""The pipeline's stages one after the other on a small folder of tables."""

import re

import corpus_pipeline
from lexweave.llm.common import documents

from .test_documents import WORD, brute_components, brute_passages


def test_pipeline(spark, docs, corpus, tmp_path):
    folder = str(tmp_path)
    shouting = spark.createDataFrame([(5000 + i, f"LOUD {i} NOISE!! " * 20, "en", "s0", 340) for i in range(60)], docs.schema)
    docs.union(shouting).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in corpus] + [(5000 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows, at = documents(spark, folder), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, folder)
        out.write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
        at[name] = rows.collect()
        assert name == "packing" or rows.columns == docs.columns
    assert {r.doc_id for r in at["quality"]} == {i for i, _ in corpus}
    kept = {i for i, (_, c) in brute_components(corpus, 5, 80).items() if i == c}
    assert {r.doc_id for r in at["near_duplicates"]} == kept
    left = [(i, t) for i, t in corpus if i in kept]
    hits = brute_passages(left)
    texts = {r.doc_id: r.text for r in at["passages"]}
    for i, t in left:
        w = WORD.findall(t)
        assert WORD.findall(texts.get(i, "")) == [x for k, x in enumerate(w) if i not in hits or not hits[i][k]]
    total = sum(len(WORD.findall(t)) for t in texts.values())
    assert abs(sum(len(WORD.findall(r.text)) for r in at["mixture"]) - 1.5 * total) < 10
    assert {r.doc_id for r in at["packing"]} == {r.doc_id for r in at["mixture"]}
    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in run) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in at["packing"])
    assert re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0])
