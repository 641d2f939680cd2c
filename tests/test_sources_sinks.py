"""Typed reads, request parsing, append, versioned publish, JSON export."""

from __future__ import annotations

import json
import os
import tempfile

from claimlake.sources import requests as R
from claimlake.sources import sinks as K
from claimlake.sources.tables import SCHEMAS, read_tables
from helpers import STATUSES, claim, table


def test_read_tables_roundtrip_with_declared_schema(spark):
    root = tempfile.mkdtemp(prefix="claimlake-tables-")
    claims = table(spark, "claims", [claim(1), claim(2, status="Paid")])
    claims.write.parquet(os.path.join(root, "claims"))
    table(spark, "statuses", STATUSES).write.parquet(os.path.join(root, "statuses"))
    got = read_tables(spark, root, ["claims", "statuses"])
    assert got["claims"].schema == SCHEMAS["claims"]
    assert got["claims"].count() == 2 and got["statuses"].count() == len(STATUSES)


def test_parse_requests_objects_arrays_and_junk(spark):
    df = spark.createDataFrame(
        [(1, '{"claim_id": 5, "physical_document_received": "YES", "is_document_received": null}'),
         (2, '[1, 2]'), (3, 'null'), (4, 'oops'), (5, '{"claim_id": "7", "is_document_received": "1",'
                                                      ' "physical_document_received": "NO"}')],
        "seq long, body string")
    got = {r.seq: (r.outcome, r.claim_id, r.is_document_received)
           for r in R.parse_requests(df, "body", ["claim_id", "is_document_received"],
                                     {"is_document_received": ["physical_document_received"]},
                                     keep=["seq"]).collect()}
    assert got == {1: ("ok", "5", "YES"), 2: ("ok", None, None), 3: ("invalid_body", None, None),
                   4: ("invalid_body", None, None), 5: ("ok", "7", "1")}


def test_append_adds_rows(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="claimlake-append-"), "claims")
    K.append(table(spark, "claims", [claim(1)]), path)
    K.append(table(spark, "claims", [claim(2)]), path)
    assert spark.read.schema(SCHEMAS["claims"]).parquet(path).count() == 2


def test_publish_switches_tables_together(spark):
    root = tempfile.mkdtemp(prefix="claimlake-publish-")
    assert K.current_version(spark, root) is None
    K.publish(spark, {"claims": table(spark, "claims", [claim(1)]),
                      "statuses": table(spark, "statuses", STATUSES)}, root, 1)
    K.publish(spark, {"claims": table(spark, "claims", [claim(1), claim(2)]),
                      "statuses": table(spark, "statuses", STATUSES[:1])}, root, 2)
    assert K.current_version(spark, root) == 2
    assert K.read_published(spark, root, "claims").count() == 2
    assert K.read_published(spark, root, "statuses").count() == 1
    assert K.read_published(spark, root, "claims", version=1).count() == 1
    # re-running a version rewrites it instead of adding to it
    K.publish(spark, {"claims": table(spark, "claims", [claim(3)]),
                      "statuses": table(spark, "statuses", STATUSES)}, root, 2)
    assert K.read_published(spark, root, "claims").count() == 1


def test_export_json_keeps_nulls_and_unicode(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="claimlake-json-"), "out")
    df = spark.createDataFrame([(1, "—", None)], "id int, label string, note string")
    K.export_json(df, path)
    lines = [line for f in sorted(os.listdir(path)) if f.endswith(".json")
             for line in open(os.path.join(path, f), encoding="utf-8")]
    assert json.loads(lines[0]) == {"id": 1, "label": "—", "note": None}
    assert "—" in lines[0]
    assert K.as_json_lines(df).first().json == '{"id":1,"label":"—","note":null}'


def test_update_batch_rewrites_only_touched_years(spark):
    import datetime as dt

    from claimlake.operators import updates as UP

    path = os.path.join(tempfile.mkdtemp(prefix="claimlake-years-"), "claims")
    claims = table(spark, "claims", [claim(1, opd_date=dt.date(2022, 5, 1)),
                                     claim(2, opd_date=dt.date(2023, 5, 1)),
                                     claim(3, opd_date=None)])
    K.write_claims(claims, path)

    def files(year):
        folder = os.path.join(path, f"opd_year={year}")
        return sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))

    before_2022, before_null = files(2022), files("__HIVE_DEFAULT_PARTITION__")
    stored = K.read_claims(spark, path, SCHEMAS["claims"])
    ups = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 2, "1", "", "INV-9")],
                                "seq long, ts timestamp_ntz, claim_id int, is_document_received string, "
                                "document_received_date string, invoice_number string")
    batch = UP.apply_document_updates(ups, stored)
    touched = K.rewrite_changed_partitions(batch.claims, batch.outcomes.where("outcome = 'accepted'"), path)
    assert touched == [2023]
    assert files(2022) == before_2022 and files("__HIVE_DEFAULT_PARTITION__") == before_null
    got = {r.r_id: (r.is_document_received, r.invoice_number)
           for r in K.read_claims(spark, path, SCHEMAS["claims"]).collect()}
    assert got == {1: (0, None), 2: (1, "INV-9"), 3: (0, None)}


def test_date_range_prunes_year_folders(spark):
    import contextlib
    import datetime as dt
    import io

    from claimlake.operators import enrich as E
    from claimlake.operators import search as S

    path = os.path.join(tempfile.mkdtemp(prefix="claimlake-prune-"), "claims")
    K.write_claims(table(spark, "claims", [claim(1, opd_date=dt.date(2022, 5, 1)),
                                           claim(2, opd_date=dt.date(2023, 5, 1)),
                                           claim(3, opd_date=dt.date(2024, 5, 1))]), path)
    stored = K.read_claims(spark, path, SCHEMAS["claims"], keep_partition=True)
    divisions = table(spark, "divisions", [{"div_code": 1, "division_name": "Ops"}])
    statuses = table(spark, "statuses", STATUSES)
    emps = spark.createDataFrame([], SCHEMAS["employees"])
    enriched = E.enrich_claims(stored, emps, divisions, statuses)
    found = S.search_claims(enriched, S.SearchFilters(date_from="2023-01-01", date_to="2023-12-31"))
    assert [r.r_id for r in found.select("r_id").collect()] == [2]
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        found.explain("formatted")
    assert "PartitionFilters: [isnotnull(opd_year" in buf.getvalue()
