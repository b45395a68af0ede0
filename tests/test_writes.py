from pyspark.sql import functions as F

from quillspark.operators import enrich
from quillspark.sources import tables


def peaks(spark):
    """Peak execution memory of each stage that is known."""
    gateway = spark.sparkContext._gateway
    nothing = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(nothing, False, False, gateway.new_array(gateway.jvm.double, 0), nothing)
    return {stages.apply(i).stageId(): stages.apply(i).peakExecutionMemory() for i in range(stages.size())}


def test_feature_tables_are_written_without_a_sort(spark, tmp_path):
    df = spark.range(3000).select("id", F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("dataset"))
    before = peaks(spark)
    tables.write_features({"likert": df}, str(tmp_path / "f"))
    after = peaks(spark)
    assert all(m == 0 for k, m in after.items() if k not in before)
    back = spark.read.parquet(str(tmp_path / "f" / "likert"))
    assert {(r.id, r.dataset) for r in back.collect()} == {(i, f"d{i % 3}") for i in range(3000)}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_more_datasets_than_open_files(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 40).cast("string").alias("dataset")).coalesce(1)
    tables.write_features({"likert": df}, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f" / "likert")).groupBy("dataset").count().where("count = 10").count() == 40


def test_annotated_texts_go_out_in_pieces(spark):
    sizes = []
    texts = ["a b. c"] * 5 + ["w " * 30000] * 3 + [None]
    for part in enrich.pieces(texts):
        sizes.append(sum(len(t or "") for t in texts[part]))
    assert len(sizes) > 2 and max(sizes) <= 60000 + enrich.PIECE
    got = enrich.annotated(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1), column="t").collect()
    assert [len(r.words) for r in sorted(got, key=lambda r: r.i)] == [3] * 5 + [30000] * 3 + [0]
