"""Property: the distributed numbering equals row_number() for any data and partitioning."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlake.operators.common import number_rows

rows = st.lists(st.tuples(st.integers(0, 4), st.integers(-50, 50)), min_size=0, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, parts=st.integers(1, 7), grouped=st.booleans())
def test_distributed_numbering_matches_row_number(spark, data, parts, grouped):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "uid long, g int, v int")
    order = ["v", "uid"]  # ties in v broken by a unique id
    groups = ["g"] if grouped else []
    got = number_rows(df, order, groups, out="pos", num_partitions=parts, total="n")
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy(*order)
    want = df.withColumn("want", F.row_number().over(w)).withColumn(
        "want_n", F.count(F.lit(1)).over(Window.partitionBy(*groups))).drop("g", "v")
    assert got.count() == len(data)
    assert got.join(want, ["uid"]).where((F.col("pos") != F.col("want")) | (F.col("n") != F.col("want_n"))).count() == 0
