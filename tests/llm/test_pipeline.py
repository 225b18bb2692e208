from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from equigauge.llm.dedup import near_duplicates
from equigauge.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_registered(spark):
    numbers = {name.split("_")[0] for name in QUERIES}
    assert numbers == {*(f"op{n}" for n in range(1, 14)), "pipeline"}
    assert set(ORACLES) <= set(QUERIES) <= set(entry_points.queries())


def test_stages_one_after_another(spark, documents, prose, tmp_path):
    rows = [(i, prose(60, i % 40), f"s{i % 3}") for i in range(80)] + [(90, prose(50, 90) + " 4111111111111111", "s1")]
    docs = documents(rows)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SMALL)
    wanted = {r["doc_id"] for r in near_duplicates(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == wanted == {*range(40), 90}
    private = corpus_pipeline.pseudonym_stage(spark, kept, SMALL)
    assert private.columns == docs.columns and private.count() == 41
    assert not private.filter("text LIKE '%4111111111111111%'").count()
    mixed = corpus_pipeline.mix_stage(spark, private, SMALL)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.encode_stage(spark, mixed, SMALL)
    assert out.count() == mixed.count()


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = corpus_pipeline.quality_stage(spark, docs, SMALL)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_rows_that_share_an_id_or_have_none(spark, documents, prose):
    """A different text under a copy's id survives, copies without an id leave one."""
    one, two, three = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(5, one, "s"), (7, one, "s"), (7, two, "s"), (None, three, "s"), (None, three, "s"), (None, prose(60, 4), "s"),
            (-3, two + " more", "s"), (9, None, "s"), (10, "", "s"), (None, None, "s"), (11, "short", "s"), (11, "short", "s")]
    docs = documents(rows).withColumn("_row_key", F.lit("clash"))
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SMALL)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = [(5, one), (-3, two + " more"), (None, three), (None, prose(60, 4)), (9, None), (10, ""), (None, None), (11, "short")]
    assert got == sorted(want, key=str)


def test_keys_sort_like_ids(spark):
    ids = [-(2**63), -5, -1, 0, 1, 2**40, 2**63 - 1, None]
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "i long, n int").orderBy(F.rand(1))
    keyed = df.select("n", corpus_pipeline.row_key(F.col("i"), F.lit("x")).alias("k"))
    assert [r["n"] for r in keyed.orderBy("k").collect()] == list(range(len(ids)))


def test_stages_with_odd_rows(spark, documents, prose):
    """Null ids and texts, repeated rows, clashing names and an empty table go through every stage."""
    rows = [(None, None, None), (1, "", "s"), (1, None, "s"), (2, prose(40, 2), None), (2, prose(40, 2), None), (None, prose(40, 3), "s")]
    for docs in (documents(rows).withColumn("_row_score", F.lit(1)), documents(rows).limit(0)):
        n = docs.count()
        good = corpus_pipeline.quality_stage(spark, docs, SMALL)
        assert good.columns == docs.columns and good.count() <= n
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == n
