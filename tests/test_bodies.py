"""JSON bodies as VARIANT: types kept, one parse, what is no object or array is rejected."""

from __future__ import annotations

from claimlake.sources import requests as R
from test_plans import plan_text

BODIES = [
    ('{"id": 7, "name": " x ", "flag": true}', ("ok", "7", " x ", "1")),
    ('{"id": "7", "name": 12.50, "flag": false}', ("ok", "7", "12.5", "")),
    ('{"id": 1e3, "name": 12345678.25, "flag": null}', ("ok", "1000", "12345678.25", None)),
    ('{"id": -0.5, "name": "é\\"", "alias": "YES"}', ("ok", "-0.5", 'é"', "YES")),
    ('{"id": [1], "name": {"a": 1}, "flag": null, "alias": 3}', ("ok", None, None, "3")),
    ('{"id": 1, "id": 2}', ("ok", "2", None, None)),
    ("{}", ("ok", None, None, None)),
    ("[1, 2]", ("ok", None, None, None)),
    ("null", ("invalid_body", None, None, None)),
    ("3", ("invalid_body", None, None, None)),
    ("", ("invalid_body", None, None, None)),
    ("not json", ("invalid_body", None, None, None)),
    (None, ("invalid_body", None, None, None)),
]


def _parsed(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BODIES)], "seq long, body string")
    return R.read_bodies(df, "body", ["id", "name", "flag"], {"flag": ["alias"]}, keep=["seq"])


def test_values_by_type(spark):
    got = [tuple(r)[1:] for r in _parsed(spark).orderBy("seq").collect()]
    assert got == [want for _, want in BODIES]


def test_each_body_is_parsed_once(spark):
    text = plan_text(_parsed(spark), "simple")
    assert text.count("parse_json(") + text.count("parseJson") == 1
