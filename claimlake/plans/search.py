"""Search queries (J1, J6, F1–F6, A8, L3, L5, U1) and their SQL oracles."""

from __future__ import annotations

import uuid

from ..operators import enrich as E
from ..operators import facets as U
from ..operators import search as S
from ..operators import trigrams as G
from ..session import scratch_path
from .registry import query
from .sqltext import SHOWN_DIVISION, SHOWN_NAME, STAFFED, ci, select_list

ENRICH_FX = ("claims", "employees", "divisions", "statuses")

# employees, then stored statuses, of each claim: lists by key, unnested (no match keeps the claim)
WIDE = f"""
WITH {STAFFED},
stages AS (SELECT {ci('status_name')} AS stage_key, list({{'s_id': s_id, 'status_order': status_order,
    'status_name': status_name}}) AS stored
  FROM fx_statuses WHERE status_name IS NOT NULL GROUP BY stage_key),
wide AS (SELECT staffed.*, unnest(COALESCE(stored, [NULL])) AS stage
  FROM staffed LEFT JOIN stages ON stage_key = {ci('status')})
"""
SEARCH_SOURCES = {
    "claim_id": "r_id", "reference_no": "reference", "computer_no": "emp_computer_number", "nic": "person.nic",
    "employee_name": SHOWN_NAME, "division": SHOWN_DIVISION, "status_id": "stage.s_id", "status_name": "status",
}
SEARCH_SQL = f"{WIDE}SELECT {select_list(S.SEARCH_COLUMNS, SEARCH_SOURCES)} FROM wide"
SEARCH_ORDER = ("ORDER BY COALESCE(wide.created_at, wide.updated_at) DESC NULLS LAST, wide.r_id DESC, "
                "person.e_id ASC NULLS FIRST, stage.s_id ASC NULLS FIRST")


def _enriched(t):
    return E.enrich_claims(t["claims"], t["employees"], t["divisions"], t["statuses"])


ENRICHED_COLUMNS = ["r_id", "reference", "emp_computer_number", "status", "claim_type", "opd_date",
                    "e_id", "nic", "initials", "surname", "division_code", "division_name",
                    "s_id", "status_order", "status_table_name"]


ENRICHED_SOURCES = {
    **{c: f"person.{c}" for c in ("e_id", "nic", "initials", "surname", "division_code", "division_name")},
    "s_id": "stage.s_id", "status_order": "stage.status_order", "status_table_name": "stage.status_name",
}


@query("enrich_claims", "J1", f"{WIDE}SELECT {select_list(ENRICHED_COLUMNS, ENRICHED_SOURCES)} FROM wide", ENRICH_FX)
def _enrich_claims(t):
    return _enriched(t).select(*ENRICHED_COLUMNS)


@query("divisions_in_use", "J6", """
SELECT min(d.division_name) AS division_name FROM fx_divisions d
WHERE d.division_name IS NOT NULL AND rtrim(d.division_name) <> ''
  AND EXISTS (SELECT 1 FROM fx_employees e WHERE e.division_code = d.div_code)
GROUP BY lower(rtrim(d.division_name))""", ("divisions", "employees"))
def _divisions_in_use(t):
    return E.divisions_in_use(t["divisions"], t["employees"])


def _contains(pattern: str) -> str:
    searched = ("reference", "emp_computer_number", "person.nic", "COALESCE(person.plain_name, '')")
    return "(" + " OR ".join(f"lower({x}) LIKE '%{pattern}%'" for x in searched) + ")"


WAITING = f"{ci('wide.status')} IN ('submitted', 'document needed', 'payment approved')"

# Representative filter values for each predicate (each also runs alone).
FILTER_CASES = {
    "filter_text": (S.SearchFilters(search="build"), _contains("build"), "F1"),
    "filter_text_wildcard": (S.SearchFilters(search=" 00_1 "), _contains("00_1"), "F1"),
    "filter_status_name": (S.SearchFilters(status="SUBMITTED "), f"{ci('wide.status')} = 'submitted'", "F2"),
    "filter_status_id": (S.SearchFilters(status="Paid", status_id="7"), "stage.s_id = 7", "F2"),
    "filter_claim_type": (S.SearchFilters(claim_type="Spectacles"), f"{ci('wide.claim_type')} = 'specs'", "F3"),
    "filter_division": (S.SearchFilters(division="NATION_7 "), f"{ci('person.division_name')} = 'nation_7'", "F4"),
    "filter_date_range": (S.SearchFilters(date_from="1995-01-01", date_to="1995-06-30 "),
                          "wide.opd_date BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'", "F5"),
    "filter_needs_action": (S.SearchFilters(needs_action="on"), WAITING, "F6"),
}

# The composed search (F1–F6 with AND) used by A8 and L3.
COMBINED = S.SearchFilters(search="mc-199", claim_type="opd", date_from="1992-01-01",
                           date_to="1998-12-31", needs_action="1")
COMBINED_SQL = (f"{_contains('mc-199')} AND {ci('wide.claim_type')} = 'opd' "
                f"AND wide.opd_date BETWEEN DATE '1992-01-01' AND DATE '1998-12-31' AND {WAITING}")


def _register_filter(name, filters, where, op_id):
    @query(name, op_id, f"{SEARCH_SQL}\nWHERE {where}", ENRICH_FX)
    def _run(t):
        rows = S.search_projection(S.search_claims(_enriched(t), filters))
        return rows.select(*S.SEARCH_COLUMNS)


for _name, (_filters, _where, _op) in FILTER_CASES.items():
    _register_filter(_name, _filters, _where, _op)


def _register_indexed(name):
    filters, where, op_id = FILTER_CASES[name]

    @query(f"{name}_indexed", op_id, f"{SEARCH_SQL}\nWHERE {where}", ENRICH_FX)
    def _run(t):
        path = scratch_path(t.spark, "claimlake", "postings", uuid.uuid4().hex)
        G.write_postings(t["claims"], t["employees"], path)
        rows = G.search_text(G.read_postings(t.spark, path), *(t[x] for x in ENRICH_FX), filters)
        return S.search_projection(rows).select(*S.SEARCH_COLUMNS)
    _run.__doc__ = "F1 by postings of three-grams, written and read back."


for _name in ("filter_text", "filter_text_wildcard"):
    _register_indexed(_name)


@query("search_claims", "F1-F6", f"{SEARCH_SQL}\nWHERE {COMBINED_SQL}", ENRICH_FX)
def _search_claims(t):
    return S.search_projection(S.search_claims(_enriched(t), COMBINED)).select(*S.SEARCH_COLUMNS)


@query("search_count", "A8", f"""{WIDE}
SELECT 3 AS current_page, 25 AS page_limit, COUNT(*) AS total_records,
  CAST(greatest(1, ceil(COUNT(*) / 25)) AS BIGINT) AS total_pages
FROM wide
WHERE {COMBINED_SQL}""", ENRICH_FX)
def _search_count(t):
    return S.search_count(_enriched(t), COMBINED, page=3, limit=25)


@query("search_page", "L3", f"""
{SEARCH_SQL}
WHERE {COMBINED_SQL}
{SEARCH_ORDER}
LIMIT 25 OFFSET 50""", ENRICH_FX)
def _search_page(t):
    return S.search_page(_enriched(t), COMBINED, page="3", limit="25")


@query("search_page_unfiltered", "L3", f"""
{SEARCH_SQL}
{SEARCH_ORDER}
LIMIT 100 OFFSET 200""", ENRICH_FX)
def _search_page_unfiltered(t):
    # limit 500 is clamped to 100
    return S.search_page_of(*(t[x] for x in ENRICH_FX), S.SearchFilters(), page=3, limit=500)


@query("search_page_deep", "L3", f"""
{SEARCH_SQL}
WHERE {WAITING} OR wide.claim_type IS NOT NULL
{SEARCH_ORDER}
LIMIT 100 OFFSET 9900""", ENRICH_FX)
def _search_page_deep(t):
    """A page that is sought by day; the claims side keeps its own predicate."""
    claims = t["claims"].where(S.needs_action_predicate("1") | S.F.col("claim_type").isNotNull())
    return S.search_page_of(claims, t["employees"], t["divisions"], t["statuses"], S.SearchFilters(), page=100, limit=100)


@query("search_page_deep_text", "L3", f"""
{SEARCH_SQL}
WHERE {_contains('mc-1')}
{SEARCH_ORDER}
LIMIT 100 OFFSET 9000""", ENRICH_FX)
def _search_page_deep_text(t):
    """A deep page of a text search: sought over the joined rows."""
    return S.search_page_of(*(t[x] for x in ENRICH_FX), S.SearchFilters(search="mc-1"), page=91, limit=100)


@query("newest_claim", "L5", f"""
{SEARCH_SQL}
{SEARCH_ORDER}
LIMIT 1""", ENRICH_FX)
def _newest_claim(t):
    return S.newest_claim(*(t[x] for x in ENRICH_FX))


@query("status_facets", "U1", f"""
WITH listed AS (SELECT {ci('status_name')} AS k, min(NULLIF(s_id, 0)) AS id, min(status_name) AS spelling,
    min(status_order) AS place FROM fx_statuses WHERE rtrim(status_name) <> '' GROUP BY k),
carried AS (SELECT {ci('status')} AS k, min(status) AS spelling, 999 AS place
  FROM fx_claims WHERE rtrim(status) <> '' GROUP BY k)
SELECT COALESCE(listed.id, 0) AS status_id, least(listed.spelling, carried.spelling) AS status_name,
  least(listed.place, carried.place) AS status_order
FROM listed FULL JOIN carried USING (k)""", ("statuses", "claims"))
def _status_facets(t):
    return U.status_facets(t["statuses"], t["claims"])
