from quern.operators.compose import records


def test_records(spark):
    rows = [('[{"a":1},{"a":2}]',), ('{"results":[{"a":3}]}',), ('{"a":4}',)]
    df = spark.createDataFrame(rows, "p string")
    from pyspark.sql import functions as F

    got = df.select(F.explode(records(F.col("p"))).alias("r")).select(F.try_variant_get("r", "$.a", "int").alias("a")).collect()
    assert sorted(r["a"] for r in got) == [1, 2, 3, 4]
