"""A summary that follows the claims by differences equals the one computed anew, after every batch."""

from __future__ import annotations

from claimlake.operators import dashboard as D
from claimlake.operators import submissions as S
from claimlake.operators import updates as W
from claimlake.operators.common import checkpointed


def _rows(df, columns=None):
    df = df.select(*(columns or df.columns))
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_summary_follows_payment_and_status_batches_and_new_claims(tables_small):
    t = tables_small
    claims, summary = t["claims"], checkpointed(D.changed_summary(D.claims_summary(t["claims"]), D.claims_summary(t["claims"].limit(0))))
    for batch in (lambda c: W.apply_payment_updates(t["payment_updates"], c),
                  lambda c: W.apply_status_updates(t["status_updates"], c, t["statuses"], t["history"])):
        done = batch(claims)
        now = checkpointed(done.claims)
        summary = checkpointed(D.changed_summary(summary, D.batch_summary_change(done.outcomes, claims, now)))
        claims = now
        columns = [*D.SUMMARY_KEYS, *D.SUMMARY_SUMS]
        assert _rows(summary, columns) == _rows(D.claims_summary(claims), columns)
    added = checkpointed(S.new_claims(S.ingest_submissions(t["submissions"], claims, t["employees"])))
    summary = D.changed_summary(summary, D.summary_change(added.limit(0), added))
    claims = claims.unionByName(added)
    sts = t["statuses"]
    for got, want in [(D.total_claims_of(summary), D.total_claims(claims)), (D.status_counts_of(sts, summary), D.status_counts(sts, claims)),
                      (D.payment_summary_of(summary), D.payment_summary(claims)), (D.claim_type_counts_of(summary), D.claim_type_counts(claims)),
                      (D.status_kpis_of(sts, summary), D.status_kpis(sts, claims)), (D.status_bars_of(sts, summary), D.status_bars(sts, claims)),
                      (D.type_share_of(summary), D.type_share(claims))]:
        assert got.columns == want.columns and _rows(got) == _rows(want)


def test_a_group_that_loses_its_last_claim_disappears(spark, tables_small):
    one = checkpointed(tables_small["claims"].limit(1))
    assert D.changed_summary(D.claims_summary(one), D.summary_change(one, one.limit(0))).count() == 0
    kept = D.changed_summary(D.claims_summary(one), D.summary_change(one, one.limit(0)), keep_empty=True).collect()
    assert [(r.n_rows, r.n_ids, float(r.payable)) for r in kept] == [(0, 0, 0.0)]
