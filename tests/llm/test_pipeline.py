"""The pipeline, stage by stage, on small tables."""

import numpy as np
from test_packing import check
from test_suffix_dedup import brute

import corpus_pipeline
from granary.llm import quality_classifier, simhash
from granary.llm.common import durable


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    good = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1").collect()}
    seen = [durable(docs, "input")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = durable(stage(spark, seen[-1], small), name)
        assert out.columns == docs.columns and out.count() <= seen[-1].count()
        seen.append(out)
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in seen]
    assert len(good & set(texts[2])) >= 0.95 * len(good & set(texts[1]))
    # one text of each group stays: those left are unlike each other, and each that went is like one that was there
    sets = {i: np.unique(simhash.shingle_hashes(t.encode(), 5)) for i, t in texts[2].items()}
    ids = sorted(sets)
    pairs = [(ids[i], ids[j]) for i, j in zip(*(x.tolist() for x in simhash.similar_pairs([sets[i] for i in ids], None, 0.8)))]
    gone = set(texts[2]) - set(texts[3])
    assert gone and gone <= {b for _, b in pairs} and sum(a in texts[3] and b in texts[3] for a, b in pairs) <= 0.1 * len(pairs)
    want = brute(list(texts[3].items()))
    for i, t in texts[4].items():
        assert len(t.encode()) <= want[i][0] - want[i][1] and len(t.encode()) >= want[i][0] - want[i][1] - 6 * want[i][2]
    check(seen[4], corpus_pipeline.run(spark, small).collect())


def test_odd_documents(spark, tmp_path, odd_docs, no_docs):
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    long = [(i, " ".join(f"word{i}x{k}" for k in range(80)), "en", i) for i in (70, 70, 71)] + [(None, " ".join(f"other{k}" for k in range(90)), None, None)] * 2
    odd = odd_docs.unionByName(spark.createDataFrame([(i, t, s, h, "x", "k", 1, True, 0, "w") for i, t, s, h in long], odd_docs.schema)).withColumnRenamed("words", "with.dot")
    for docs, left in ((odd, {70: 1, 71: 1, None: 1}), (no_docs.withColumnRenamed("words", "with.dot"), {})):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = durable(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == odd.columns
        rows = [r["doc_id"] for r in docs.collect()]
        assert {i: rows.count(i) for i in left} == left and len([i for i in rows if i in left]) == sum(left.values())
        assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == len(rows)


def test_classifier_stage_learns_from_known_rows_only(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    known = corpus_pipeline._known_labels(spark, small)
    assert 0 < known.count() < labels.count() and known.filter(quality_classifier.held_out("doc_id")).count() == 0
