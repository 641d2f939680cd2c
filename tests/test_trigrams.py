"""Text search by postings finds what the full scan finds."""

from __future__ import annotations

import pyarrow as pa
import pytest

from claimlake.operators import enrich as E
from claimlake.operators import search as S
from claimlake.operators import trigrams as G
from helpers import STATUSES, claim, employee, table
from test_plans import plan_text


@pytest.fixture(scope="module")
def tables(spark):
    claims = [claim(1, reference="MC-2024-00001"), claim(2, reference="mc-2023-10002", emp_computer_number="ab12"),
              claim(3, reference=None, emp_computer_number="AB12 "), claim(4, reference="É%_x\\y", emp_computer_number=None),
              claim(5, reference="MC", emp_computer_number="000009"), claim(6, reference="aaaa", emp_computer_number="nobody")]
    staff = [employee(1, "000001", "911V", initials="J.", surname="Perera"), employee(2, "AB12", "922v", initials=None, surname="de Silva"),
             employee(3, "ab12", "933V", initials="K", surname=None), employee(4, "000009", None, initials="", surname="PERERA")]
    divisions = spark.createDataFrame([(1, "North")], "div_code int, division_name string")
    return table(spark, "claims", claims), table(spark, "employees", staff), divisions, table(spark, "statuses", STATUSES)


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings") / "p")
    G.write_postings(tables[0], tables[1], path)
    return G.read_postings(spark, path)


TERMS = ["", "mc-2", "MC-2024", "2_24", "2%1", "per", "j. per", "J._Per", "silva", "ab12", "B12", "911v", "É%_x", "x\\y", "\\%_x", "\\_x\\\\",
         "aaa", "aaaa", "zzz", "00", "0000", "mc", " k ", "v", "_____"]


@pytest.mark.parametrize("term", TERMS)
def test_same_rows_as_the_scan(tables, index, term):
    filters = S.SearchFilters(search=term)
    want = S.search_projection(S.search_claims(E.enrich_claims(*tables), filters)).collect()
    got = S.search_projection(G.search_text(index, *tables, filters)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_grams_of_terms():
    assert G.term_grams("ab") == [] and G.term_grams("a%bc_d") == []
    assert G.term_grams("MC-2%04") == ["c-2", "mc-"]
    assert G.term_grams("a\\%b") == ["a%b"]


def test_few_candidates_prune_the_claims_and_other_filters_hold(tables, index):
    filters = S.SearchFilters(search="perera", status="submitted", claim_type="opd")
    rows = G.search_text(index, *tables, filters)
    text = plan_text(rows)
    assert "r_id" in text
    assert sorted(r.r_id for r in rows.collect()) == sorted(r.r_id for r in S.search_claims(E.enrich_claims(*tables), filters).collect())


def test_lookups_read_few_row_groups(spark, tables, index):
    hits = index.where(index["gram"].isin(["per"]))
    assert "PushedFilters: [In(gram" in plan_text(hits) or "PushedFilters: [IsNotNull(gram), EqualTo(gram,per)]" in plan_text(hits)


def test_a_gram_is_a_list_per_block(spark, tables, tmp_path):
    claims = table(spark, "claims", [claim(i, reference=f"MC-2024-{i:05}", emp_computer_number="000001") for i in range(1, 301)]).coalesce(1)
    G.write_postings(claims, tables[1], str(tmp_path / "p"), block_rows=128)
    index = G.read_postings(spark, str(tmp_path / "p"))
    lists = index.where((index["gram"] == "mc-") & (index["field"] == "reference")).orderBy("block").collect()
    assert [len(r.ids) for r in lists] == [128, 128, 44]
    assert sorted(i for r in lists for i in r.ids) == list(range(1, 301))
    assert {len(r.ids) for r in index.where(index["gram"] == "000").where("field = 'emp_computer_number'").collect()} == {128, 44}


def test_lists_of_texts():
    texts = ["aaaa", None, "", "ab", "abc", "xabcabc", "é€😀é€😀", "€😀é", "zz\x00z"]
    grams, starts, place = G._gram_lists(pa.array(texts, pa.string()))
    want = {}
    for at, t in enumerate(texts):
        for g in {t[i:i + 3] for i in range(len(t) - 2)} if t else ():
            want.setdefault(g, []).append(at)
    assert grams == sorted(want) and {g: list(place[starts[i]:starts[i + 1]]) for i, g in enumerate(grams)} == want
    assert G._gram_lists(pa.array(["ab", None], pa.string()))[0] == [] == G._gram_lists(pa.array([], pa.string()))[0]


@pytest.mark.parametrize("term", ["mc-2", "2_24", "per", "j. per", "ab12", "É%_x", "aaaa", "0000"])
def test_same_rows_from_small_blocks_and_repeated_ids(spark, tables, tmp_path, term):
    both = tables[0].unionByName(table(spark, "claims", [claim(1, reference="PER aaaa", emp_computer_number="AB12"), claim(3, reference="mc-2")]))
    G.write_postings(both.coalesce(1), tables[1].coalesce(1), str(tmp_path / "p"), block_rows=2)
    filters = S.SearchFilters(search=term)
    want = S.search_projection(S.search_claims(E.enrich_claims(both, *tables[1:]), filters)).collect()
    got = S.search_projection(G.search_text(G.read_postings(spark, str(tmp_path / "p")), both, *tables[1:], filters)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
