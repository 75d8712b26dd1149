"""Vectors as text are what DuckDB's printf gives, on ties and odd values too."""

import duckdb
from pyspark.sql import functions as F

from lorequarry import queries
from lorequarry.functions import text as X


def test_odd_values(spark, tmp_path):
    vectors = [
        [0.0078125, 0.0234375, -48.7890625, 14.0078125], [1e10, 3.4e38, 16777218.0, 1e-45], [-0.0, 5e-7, -4e-7, 1.0000005],
        [float("nan"), float("inf"), float("-inf")], [None, 1.0, None], [None], [], None,
    ]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = duck.sql(queries.ORACLE_SQL["vector_literals"]).fetchall()
    got = [tuple(r) for r in queries.vector_literals(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(wanted) and dict(got)[0] == "[0.007812,0.023438,-48.789062,14.007812]"


def test_digits_of_doubles(spark):
    one = spark.range(1).select(X.vector_literal(F.array(F.lit(0.125), F.lit(2.675), F.lit(1e22)), 2))
    assert one.first()[0] == "[0.12,2.67,10000000000000000000000.00]"
