"""J7 on stored claims: row groups carry a Bloom filter of the reference, and lookups skip by it."""

from __future__ import annotations

import os

import pytest

from claimlake.operators import submissions as W
from claimlake.sources import sinks as K
from claimlake.sources.tables import SCHEMAS


@pytest.fixture(scope="module")
def stored(spark, tables_small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("claims") / "by-year")
    K.write_claims(tables_small["claims"].repartition(4), path, distinct_references=2000)
    return path, K.read_claims(spark, path, SCHEMAS["claims"], keep_key=True)


def _columns_with_filter(spark, file) -> set[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return {c.getPath().toDotString() for block in reader.getFooter().getBlocks() for c in block.getColumns() if c.getBloomFilterOffset() >= 0}
    finally:
        reader.close()


def test_only_the_reference_has_a_filter(spark, stored):
    files = [os.path.join(d, f) for d, _, names in os.walk(stored[0]) for f in names if f.endswith(".parquet")]
    assert files and all(_columns_with_filter(spark, f) == {"reference_key"} for f in files)


def _rows_read(df) -> int:
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_skip_row_groups(spark, stored, tables_small):
    _, claims = stored
    # inside the range of the stored references, but none of them
    absent = [f"mc-1995-{i:06d}x" for i in range(300, 700, 40)]
    assert _rows_read(claims.where(claims["reference_key"].isin(absent)).select("reference_key")) == 0
    one = tables_small["claims"].orderBy("r_id").first()
    rows = _rows_read(claims.where(claims["reference_key"].isin([one.reference.lower()])).select("reference_key"))
    assert 0 < rows < tables_small["claims"].count() / 4


@pytest.mark.parametrize("literals", [500, 2])
def test_same_answers(spark, stored, tables_small, monkeypatch, literals):
    monkeypatch.setattr(W, "LITERAL_REFERENCES", literals)
    refs = [r.reference for r in tables_small["claims"].limit(5).collect()]
    asked = spark.createDataFrame([(i, r) for i, r in enumerate([*refs, refs[0].lower() + "  ", "nothing", None, ""])], "seq long, reference string")
    got = sorted(tuple(r) for r in W.reference_exists(asked, stored[1]).select("seq", "reference_exists").collect())
    assert got == sorted(tuple(r) for r in W.reference_exists(asked, tables_small["claims"]).select("seq", "reference_exists").collect())
    assert [g for _, g in got] == [True] * 6 + [False] * 3
    assert not any(r.reference_exists for r in W.reference_exists(asked.limit(0), stored[1]).collect())
