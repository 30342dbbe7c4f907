import os

from ecospark.functions.clean import standardise_units
from ecospark.streaming import curate_stream


def test_stream_applies_stateless_operator(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    spark.createDataFrame([(1, 2.0, "ug/L"), (2, 3.0, "%")], "id int, value double, unit string").write.parquet(src)
    q = curate_stream(spark, src, "id int, value double, unit string",
                      lambda df: standardise_units(df, "value", "unit"),
                      os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    got = sorted((r.id, r.value, r.unit) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect())
    assert got == [(1, 0.002, "mg/L"), (2, 30000.0, "mg/L")]
