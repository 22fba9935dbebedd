"""The pipeline's stages, one after another, against what each promises of its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.conftest import SMALL
from watchtide.llm.sentence_spans import remove_repeats
from watchtide.llm.source_mixing import mix_sources
from watchtide.llm.toxic_segments import learn_toxicity, score_toxicity
from watchtide.session import scratch_path


def test_stages(texts_session):
    spark, docs = texts_session, texts_session.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, kept[-1], SMALL).write.parquet(path)
        kept.append(spark.read.parquet(path))
    assert [n for n, _f in corpus_pipeline.STAGES] == ["toxicity", "simhash_neardup", "substring_dedup", "source_mixing", "sentencepiece"]
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    assert all(after <= before for before, after in zip(ids, ids[1:])) and len(ids[-1]) > 0.2 * len(ids[0])
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = score_toxicity(docs, learn_toxicity(docs, labels)).filter("predicted = 0")
    assert ids[1] == {r[0] for r in scores.select("doc_id").collect()}
    texts = [r[0] for r in kept[2].select("text").collect()]
    assert len(texts) == len(set(texts))
    assert {r[0]: r[1] for r in kept[3].select("doc_id", "text").collect()} == {
        r[0]: r[1] for r in remove_repeats(kept[2]).select("doc_id", "text").collect()
    }
    assert kept[3].filter(F.length("text") != F.col("n_chars")).join(kept[2].select("doc_id", "n_chars"), ["doc_id", "n_chars"], "left_anti").count() == 0
    assert ids[4] == {r[0] for r in mix_sources(kept[3]).filter("sampled").select("doc_id").collect()}
    assert ids[5] == ids[4]
    again = corpus_pipeline.run(spark, SMALL)
    assert sorted(again.collect()) == sorted(kept[-1].collect())


def test_stages_keep_extra_columns_and_nulls(texts_session, documents):
    rows = [(1, "one two three. " * 5), (2, None), (3, ""), (None, "no id at all"), (4, "x" * 9000), (5, "one two three. " * 5)]
    docs = documents(rows)
    for name in ("score", "keep", "bits", "print_id", "n_removed", "held", "tokens", "p", "sampled", "topic", "weight"):
        docs = docs.withColumn(name, F.lit(name))
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(texts_session, docs, SMALL)
        assert out.columns == docs.columns
        assert {r["p"] for r in out.collect()} <= {"p"}
    empty = docs.limit(0)
    for _name, stage in corpus_pipeline.STAGES:
        assert stage(texts_session, empty, SMALL).collect() == []
