"""Invariants across operators, and exactness of the skew-safe numbering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlake.functions.text import ci
from claimlake.operators import dashboard as D
from claimlake.operators import enrich as E
from claimlake.operators import search as S
from claimlake.operators import submissions as W
from claimlake.operators import updates as UP
from claimlake.operators.common import number_rows


def test_total_equals_sum_of_type_counts(tables_small):
    t = tables_small
    total = D.total_claims(t["claims"]).first().total_claims
    assert total == sum(r.total for r in D.claim_type_counts(t["claims"]).collect())
    assert sum(r.total for r in D.status_counts(t["statuses"], t["claims"]).collect()) <= total


def test_pages_concatenate_to_full_sorted_result(tables_small):
    t = tables_small
    enriched = E.enrich_claims(t["claims"], t["employees"], t["divisions"], t["statuses"])
    filters = S.SearchFilters(claim_type="specs", needs_action="yes")
    n = S.search_count(enriched, filters, limit=7).first()
    pages = []
    for page in range(1, n.total_pages + 1):
        pages += [tuple(r) for r in S.search_page(enriched, filters, page=page, limit=7).collect()]
    rows = S.search_projection(S.search_claims(enriched, filters))
    full = [tuple(r) for r in rows.orderBy(*S.newest_first(rows)).select(*S.SEARCH_COLUMNS).collect()]
    assert len(full) == n.total_records and pages == full


def test_outcomes_partition_the_input(tables_small):
    t = tables_small
    subs = t["submissions"]
    res = W.ingest_submissions(subs, t["claims"], t["employees"])
    assert res.count() == subs.count() == res.select("seq").distinct().count()
    status = UP.apply_status_updates(t["status_updates"], t["claims"], t["statuses"], t["history"])
    assert status.outcomes.count() == t["status_updates"].count()


def test_references_unique_after_ingest(tables_small):
    t = tables_small
    res = W.ingest_submissions(t["submissions"], t["claims"], t["employees"])
    new = W.new_claims(res)
    after = t["claims"].select("reference").unionByName(new.select("reference"))
    table_dups = t["claims"].groupBy(ci("reference")).count().where("count > 1").count()
    assert after.groupBy(ci("reference")).count().where("count > 1").count() == table_dups
    ids = new.select("r_id").collect()
    assert len({r.r_id for r in ids}) == len(ids)


def test_final_status_is_last_replayed(tables_small):
    t = tables_small
    res = UP.apply_status_updates(t["status_updates"], t["claims"], t["statuses"], t["history"])
    order = t["status_updates"].select("seq", "ts")
    last = (res.replay.join(order, "seq")
            .groupBy("claim_id").agg(F.max_by("new_status", F.struct("ts", "seq")).alias("want")))
    got = res.claims.join(last, res.claims["r_id"] == last["claim_id"])
    assert got.where(~F.col("status").eqNullSafe(F.col("want"))).count() == 0
    # each replayed old status is the previous new status of the same claim
    w = Window.partitionBy("claim_id").orderBy("ts", "seq")
    chk = (res.replay.join(order, "seq")
           .withColumn("prev", F.lag("new_status").over(w))
           .where(F.col("prev").isNotNull() & ~F.col("old_status").eqNullSafe(F.col("prev"))))
    assert chk.count() == 0


def test_number_rows_exact_under_a_hot_group(spark):
    # one group holds a third of the rows; the numbering must still equal row_number()
    n = 30_000
    df = spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 997).alias("g"))
    got = number_rows(df, ["seq"], ["g"], out="pos", num_partitions=16)
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("seq")))
    bad = got.join(want, ["seq", "g"]).where(F.col("pos") != F.col("want"))
    assert got.count() == n and bad.count() == 0
    glob = number_rows(df, ["seq"], out="pos", num_partitions=16)
    assert glob.where(F.col("pos") != F.col("seq") + 1).count() == 0
    default = number_rows(df, ["seq"], ["g"], out="pos")
    assert default.join(want, ["seq", "g"]).where(F.col("pos") != F.col("want")).count() == 0


def test_deep_pages_use_exact_fallback(spark, tables_small):
    from claimlake.operators import employee as M

    t = tables_small
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    cols = ["request_id", "position", "claim_id"]
    want = sorted(tuple(r) for r in M.paged_per_employee(t["access_requests"], t["claims"]).select(*cols).collect())
    old = spark.conf.get(key)
    spark.conf.set(key, "5")  # every page bound is now "deep"
    try:
        got = sorted(tuple(r) for r in M.paged_per_employee(t["access_requests"], t["claims"]).select(*cols).collect())
    finally:
        spark.conf.set(key, old)
    assert got == want and len(got) > 0


def test_field_update_outcomes_partition_the_input(tables_small):
    t = tables_small
    for op, name in [(UP.apply_document_updates, "document_updates"), (UP.apply_medical_updates, "medical_updates"),
                     (UP.apply_payment_updates, "payment_updates")]:
        res = op(t[name], t["claims"])
        n = t[name].count()
        assert res.outcomes.count() == n == res.outcomes.select("seq").distinct().count(), name
        assert res.claims.count() == t["claims"].count(), name  # updates never add or drop claims


def test_assigned_references_are_unique_and_repeatable(tables_small):
    t = tables_small
    first = W.assign_references(t["submissions"], t["claims"])
    assigned = first.where("assigned")
    n = assigned.count()
    assert n > 0
    assert assigned.select(ci("reference")).distinct().count() == n
    taken = t["claims"].select(ci("reference").alias("k"))
    assert assigned.join(taken, ci(assigned["reference"]) == taken["k"], "left_semi").count() == 0
    again = W.assign_references(t["submissions"], t["claims"])
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
