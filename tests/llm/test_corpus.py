import corpus_pipeline
from pyspark.sql import functions as F

from tillcast.llm.decontam import contaminated
from tillcast.llm.neardup import near_duplicates
from tillcast.llm.passages import repeated_passages


def test_every_stage_takes_effect_and_keeps_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    junk = docs.limit(1).withColumns({"doc_id": F.lit(10_001).cast("long"), "text": F.lit("*** 12 ||| ***")})
    copy = docs.where("doc_id = 5").withColumn("doc_id", F.lit(10_002).cast("long"))
    docs = docs.unionByName(junk).unionByName(copy)
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, sf_dir).cache()
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString(), name
        if name == "language_id":
            assert {r.doc_id for r in held.select("doc_id").collect()} - {r.doc_id for r in after.select("doc_id").collect()} == {10_001}
        if name == "near_duplicates":
            assert after.count() == near_duplicates(held).select("class_id").distinct().count()
        if name == "repeated_passages":
            assert repeated_passages(after).count() == 0
        if name == "decontamination":
            assert contaminated(after, benchmark).count() == 0
            assert after.count() == held.count() - contaminated(held, benchmark).select("doc_id").distinct().count()
        held = after
    packed = corpus_pipeline.STAGES[-1][1](spark, held, sf_dir)
    assert packed.select("doc_id").distinct().count() == held.count()


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


def test_a_stage_lets_go_what_earlier_ones_kept():
    import public_tokenizers

    from tillcast.llm.common import forget
    from tillcast.llm.packing import encoder

    own = encoder(public_tokenizers.path("word_bpe_49k.json"), corpus_pipeline.MEMO_BYTES)
    own.encode("some words")
    assert own._kept.young and own._kept.limit == corpus_pipeline.MEMO_BYTES
    forget()
    assert encoder.cache_info().currsize == 0
