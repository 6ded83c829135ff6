import corpus_pipeline
from helpers import rows
from pyspark.sql import functions as F

from wordtide.llm import chosen_path, fertility, latent, pieces, toxicity
from wordtide.llm.common import Scratch


def test_stages(spark, sf):
    """Each stage's rows against those of its operator, decided apart from it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "near duplicates", "decontamination", "encoding"]
    scratch, out = Scratch(spark, "t"), []
    for n, f in corpus_pipeline.STAGES:
        docs = scratch.keep(f(spark, docs, sf), n.replace(" ", "-"))
        out.append(docs)
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in out[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in out]
    first = spark.read.parquet(f"{sf}/documents.parquet")
    assert ids[0] == {r.doc_id for r in fertility.query(spark, sf).filter("kept").collect()}
    model = toxicity.train(spark, out[0], labels)
    assert ids[1] == {r.doc_id for r in out[0].select("doc_id", toxicity.scores(spark, F.col("text"), model).alias("t")).filter("t.predicted = 0").collect()}
    assert ids[2] == {r.doc_id for r in chosen_path.groups(spark, out[1]).filter("kept").collect()}
    leaked = {r.doc_id for r in latent.leaks(spark, out[2], bench, Scratch(spark, "t")).collect()}
    assert ids[3] == ids[2] - leaked and ids[4] == ids[3]
    assert rows(out[4], "doc_id", "ids_crc32") == rows(out[3].select("doc_id", pieces.encoded(F.col("text")).alias("e")).select("doc_id", "e.ids_crc32"))
    whole = corpus_pipeline.run(spark, sf)
    assert rows(whole, "doc_id", "ids_crc32") == rows(out[4], "doc_id", "ids_crc32") and first.count() > whole.count() > 0


def test_stages_take_odd_and_empty_tables(spark, odd, none, sf, tmp_path):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (odd.select(*plain), none.select(*plain), odd):
        docs = start
        for _, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, sf)
            assert docs.columns == start.columns
        docs.count()
