"""SQL fragments shared by the oracle texts (DuckDB dialect)."""

from __future__ import annotations

# characters stripped by the server-side trim (blank, tab, LF, CR, NUL, VT)
PHP_TRIM_SET = "' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)"
# characters stripped by the browser-side trim
JS_TRIM_SET = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(65279)"


def php_trim(x: str) -> str:
    return f"trim({x}, {PHP_TRIM_SET})"


def text_or_empty(x: str) -> str:
    return f"COALESCE({php_trim(x)}, '')"


def blank_to_null(x: str) -> str:
    return f"NULLIF({php_trim(x)}, '')"


def ci(x: str) -> str:
    return f"lower(rtrim({x}))"


# one employee per (computer number, NIC) pair (smallest e_id)
EMP_BY_CREDENTIALS = """emp2 AS (SELECT * FROM (SELECT e.*, row_number() OVER (
    PARTITION BY lower(rtrim(computer_number)), lower(rtrim(nic)) ORDER BY e_id) AS _rn
    FROM fx_employees e) WHERE _rn = 1)"""


def lookup(table: str, key: str, value: str, at: str) -> str:
    """One value found by key; DuckDB reports an error where the key is not unique."""
    return f"(SELECT {value} FROM {table} WHERE {key} = {at})"


# all employees of a computer number as one list, smallest e_id first
PEOPLE = f"""people AS (
  SELECT {ci('computer_number')} AS person_key, list({{'e_id': e_id, 'nic': nic, 'initials': initials,
    'surname': surname, 'division_code': division_code,
    'division_name': {lookup('fx_divisions', 'div_code', 'division_name', 'division_code')},
    'plain_name': COALESCE(array_to_string([initials, surname], ' '), '')}} ORDER BY e_id) AS found
  FROM fx_employees WHERE computer_number IS NOT NULL GROUP BY person_key)"""

# claims with one row per employee of their computer number, or one row without
STAFFED = f"""{PEOPLE},
staffed AS (SELECT fx_claims.*, unnest(COALESCE(found, [NULL])) AS person
  FROM fx_claims LEFT JOIN people ON person_key = {ci('emp_computer_number')})"""

SHOWN_NAME = "CASE WHEN trim(person.plain_name) <> '' THEN trim(person.plain_name) ELSE COALESCE(patient_name, 'Unknown Employee') END"
SHOWN_DIVISION = "CASE WHEN rtrim(person.division_name) <> '' THEN person.division_name ELSE 'Not Assigned' END"


def select_list(columns: list[str], computed: dict[str, str]) -> str:
    """The columns of a result contract: computed ones by their expression, others as they are."""
    return ", ".join(f"{computed[c]} AS {c}" if c in computed else c for c in columns)
