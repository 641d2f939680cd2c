"""Tiny hand-made tables for edge tests."""

from __future__ import annotations

import datetime as dt

from claimlake.sources.tables import SCHEMAS


def table(spark, name: str, rows: list[dict]):
    schema = SCHEMAS[name]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def claim(r_id: int, **kw) -> dict:
    base = {"r_id": r_id, "reference": f"MC-2024-{r_id:05d}", "opd_date": dt.date(2024, 1, 1),
            "amount_requested": 100.0, "claim_type": "opd", "patient_name": f"P{r_id}",
            "emp_computer_number": "000001", "is_document_received": 0,
            "created_at": dt.datetime(2024, 1, 1, 9), "updated_at": dt.datetime(2024, 1, 2),
            "claim_for": "MYSELF", "status": "Submitted"}
    base.update(kw)
    return base


def employee(e_id: int, cn: str, nic: str = "1V", **kw) -> dict:
    base = {"e_id": e_id, "computer_number": cn, "nic": nic, "initials": "A.", "surname": "SMITH",
            "division_code": 1, "balance_opd_amount": 10000.0, "balance_specs_amount": 10000.0}
    base.update(kw)
    return base


STATUSES = [
    {"s_id": 1, "status_name": "Submitted", "status_order": 10},
    {"s_id": 2, "status_name": "Received Document", "status_order": 20},
    {"s_id": 7, "status_name": "Payment Approved", "status_order": 70},
    {"s_id": 8, "status_name": "Paid", "status_order": 80},
]
