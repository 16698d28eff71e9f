"""The classifiers written as portable SQL (DuckDB dialect), generated from the
same vocabularies, request wordings and attempt limits as the Column forms: a second
engine for the same rules, not a second source of them.  The values themselves are
held by literal tests.  Usable by anyone who prefers SQL over the DataFrame API.
"""

from __future__ import annotations

from ..functions.rules import any_match_sql, first_match_keyword_sql, keyword_label_sql
from ..functions.text import (
    after_colon_sql,
    blank_sql,
    clean_description_sql,
    normalize_label_sql,
    normalize_yes_no_sql,
    present_sql,
    py_strip_sql,
    sql_str,
)
from ..functions.vocab import (
    CATEGORY_LABELS,
    CATEGORY_RULES,
    DISTRICT_KEYWORDS,
    FACILITY_LABELS,
    NO_DESCRIPTION,
    REVIEW_KEYWORDS,
    RURAL_KEYWORDS,
    STAGE_PARAMS,
    DESCRIPTION_ERROR_PREFIX,
    MAX_ATTEMPTS,
    COST_PER_1K_TOKENS,
)
from ..operators.classify import DESCRIPTION_PROMPT_HEAD, DESCRIPTION_PROMPT_TAIL
from ..operators.enrich import EMPTY_RESPONSE_ERROR

PC = '"Product Category"'
FS = '"Facility Suitability"'
SD = "SIMPLE_DESCRIPTION"


class Sql:
    """Accumulates named CTEs; ``query`` closes the WITH clause."""

    def __init__(self):
        self.ctes: list[tuple[str, str]] = []

    def add(self, name: str, body: str) -> str:
        self.ctes.append((name, body))
        return name

    def query(self, final: str) -> str:
        if not self.ctes:
            return final
        return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in self.ctes) + "\n" + final


def _part(prefix: str, col: str) -> str:
    return f"CASE WHEN {present_sql(col)} THEN {sql_str(prefix)} || {col} ELSE '' END"


def rid_sql(stage: str, ctx: str) -> str:
    return f"sha256({sql_str(stage)} || chr(1) || {ctx})"


def label_answers(q: Sql, name: str, completions: str, labels: list[str]) -> str:
    """``(request_id, ans)``: answers normalised onto ``labels``."""
    q.add(f"{name}_s", f"SELECT request_id, {py_strip_sql('response')} AS r1 FROM {completions}")
    q.add(f"{name}_c", f"SELECT request_id, {after_colon_sql('r1')} AS r2 FROM {name}_s")
    return q.add(name, f"SELECT request_id, {normalize_label_sql('r2', labels)} AS ans FROM {name}_c")


def yes_no_answers(q: Sql, name: str, completions: str) -> str:
    return q.add(name, f"SELECT request_id, {normalize_yes_no_sql('response')} AS ans FROM {completions}")


# --- category ------------------------------------------------------------------------

def category_trace(q: Sql, base: str, existing: str | None = None, prefix: str = "c") -> str:
    """Adds _cat_kw, _cat_subkw, _cat_src, _cat_ctx, _cat_rid."""
    fmk_d = first_match_keyword_sql("lower(DESCRIPTION)", CATEGORY_RULES)
    fmk_s = first_match_keyword_sql("lower(SUBCATEGORY)", CATEGORY_RULES)
    q.add(f"{prefix}1", f"SELECT *, {fmk_d} AS _cat_kw, CASE WHEN {present_sql('SUBCATEGORY')} THEN {fmk_s} END AS _cat_subkw FROM {base}")
    pres = f"WHEN {present_sql(existing)} THEN 'preserved' " if existing else ""
    q.add(
        f"{prefix}2",
        f"SELECT *, CASE {pres}WHEN {blank_sql('DESCRIPTION')} THEN 'blank' WHEN _cat_kw IS NOT NULL THEN 'description' "
        f"WHEN _cat_subkw IS NOT NULL THEN 'subcategory' ELSE 'residual' END AS _cat_src FROM {prefix}1",
    )
    ctx = f"'Description: ' || DESCRIPTION || {_part(', Vendor: ', 'VENDOR_NAME')} || {_part(', Subcategory: ', 'SUBCATEGORY')}"
    q.add(f"{prefix}3", f"SELECT *, CASE WHEN _cat_src = 'residual' THEN {ctx} END AS _cat_ctx FROM {prefix}2")
    return q.add(f"{prefix}4", f"SELECT *, {rid_sql('category', '_cat_ctx')} AS _cat_rid FROM {prefix}3")


def category_label(q: Sql, traced: str, answers: str | None = None, existing: str | None = None, prefix: str = "c", replace: bool = False) -> str:
    if answers:
        q.add(f"{prefix}5", f"SELECT t.*, a.ans AS _cat_ans FROM {traced} t LEFT JOIN {answers} a ON t._cat_rid = a.request_id")
        fallback = "coalesce(_cat_ans, 'Needs Review')"
        src = f"{prefix}5"
    else:
        fallback = "'Needs Review'"
        src = traced
    pres = f"WHEN 'preserved' THEN {existing} " if existing else ""
    label = (
        f"CASE _cat_src {pres}WHEN 'blank' THEN 'Uncategorized' "
        f"WHEN 'description' THEN {keyword_label_sql('_cat_kw', CATEGORY_RULES)} "
        f"WHEN 'subcategory' THEN {keyword_label_sql('_cat_subkw', CATEGORY_RULES)} ELSE {fallback} END"
    )
    if replace:
        return q.add(f"{prefix}6", f"SELECT * REPLACE ({label} AS {PC}) FROM {src}")
    return q.add(f"{prefix}6", f"SELECT *, {label} AS {PC} FROM {src}")


def requests_sql(traced: str, stage: str, p: str) -> str:
    mt, temp = STAGE_PARAMS[stage]
    return (
        f"SELECT {p}_rid AS request_id, {sql_str(stage)} AS stage, {p}_ctx AS context, "
        f"CAST({mt} AS INTEGER) AS max_tokens, CAST({temp} AS DOUBLE) AS temperature "
        f"FROM {traced} WHERE {p}_src = 'residual'"
    )


# --- facility --------------------------------------------------------------------------

def facility_trace(q: Sql, base: str, category_col: str = PC, prefix: str = "f") -> str:
    q.add(
        f"{prefix}1",
        f"SELECT *, {any_match_sql('lower(DESCRIPTION)', REVIEW_KEYWORDS)} AS _fac_review, "
        f"{any_match_sql('lower(DESCRIPTION)', RURAL_KEYWORDS)} AS _fac_rural, "
        f"{any_match_sql('lower(DESCRIPTION)', DISTRICT_KEYWORDS)} AS _fac_district FROM {base}",
    )
    q.add(
        f"{prefix}2",
        f"SELECT *, CASE WHEN {blank_sql('DESCRIPTION')} THEN 'blank' WHEN _fac_review THEN 'review' "
        f"WHEN _fac_rural OR _fac_district THEN 'rule' ELSE 'residual' END AS _fac_src FROM {prefix}1",
    )
    ctx = f"'Description: ' || DESCRIPTION || {_part(', Category: ', category_col)} || {_part(', Vendor: ', 'VENDOR_NAME')}"
    q.add(f"{prefix}3", f"SELECT *, CASE WHEN _fac_src = 'residual' THEN {ctx} END AS _fac_ctx FROM {prefix}2")
    return q.add(f"{prefix}4", f"SELECT *, {rid_sql('facility', '_fac_ctx')} AS _fac_rid FROM {prefix}3")


def facility_label(q: Sql, traced: str, answers: str | None = None, prefix: str = "f") -> str:
    if answers:
        q.add(f"{prefix}5", f"SELECT t.*, a.ans AS _fac_ans FROM {traced} t LEFT JOIN {answers} a ON t._fac_rid = a.request_id")
        fallback = "coalesce(_fac_ans, 'Needs Review')"
        src = f"{prefix}5"
    else:
        fallback = "'Needs Review'"
        src = traced
    label = (
        "CASE WHEN _fac_src IN ('blank', 'review') THEN 'Needs Review' "
        "WHEN _fac_rural AND _fac_district THEN 'Both' WHEN _fac_rural THEN 'Rural Clinics' "
        f"WHEN _fac_district THEN 'District Hospitals' ELSE {fallback} END"
    )
    return q.add(f"{prefix}6", f"SELECT *, {label} AS {FS} FROM {src}")


# --- electricity -----------------------------------------------------------------------

def electricity_trace(q: Sql, base: str, vocabulary: list[str], category_col: str = PC, prefix: str = "e") -> str:
    words = [w.lower() for w in vocabulary]
    q.add(
        f"{prefix}1",
        f"SELECT *, CASE WHEN {blank_sql('DESCRIPTION')} THEN 'blank' WHEN {any_match_sql('lower(DESCRIPTION)', words)} "
        f"THEN 'rule' ELSE 'residual' END AS _ele_src FROM {base}",
    )
    ctx = f"'Description: ' || DESCRIPTION || {_part(', Category: ', category_col)}"
    q.add(f"{prefix}2", f"SELECT *, CASE WHEN _ele_src = 'residual' THEN {ctx} END AS _ele_ctx FROM {prefix}1")
    return q.add(f"{prefix}3", f"SELECT *, {rid_sql('electricity', '_ele_ctx')} AS _ele_rid FROM {prefix}2")


def electricity_label(q: Sql, traced: str, answers: str | None, prefix: str = "e") -> str:
    if answers:
        q.add(f"{prefix}4", f"SELECT t.*, a.ans AS _ele_ans FROM {traced} t LEFT JOIN {answers} a ON t._ele_rid = a.request_id")
        fallback = "coalesce(_ele_ans, 'Needs Review')"
        src = f"{prefix}4"
    else:
        fallback = "'Needs Review'"
        src = traced
    label = f"CASE _ele_src WHEN 'blank' THEN 'Needs Review' WHEN 'rule' THEN 'Yes' ELSE {fallback} END"
    return q.add(f"{prefix}5", f'SELECT *, {label} AS "Requires Electricity" FROM {src}')


# --- description ----------------------------------------------------------------------------

def description_trace(q: Sql, base: str, first_n: int | None = None, row_col: str = "_row", prefix: str = "d") -> str:
    src = f"CASE WHEN {blank_sql('DESCRIPTION')} THEN 'blank' ELSE 'residual' END"
    if first_n:
        src = f"CASE WHEN {row_col} >= {first_n} THEN 'skipped' ELSE {src} END"
    q.add(f"{prefix}1", f"SELECT *, {src} AS _desc_src FROM {base}")
    ctx = (
        f"{sql_str(DESCRIPTION_PROMPT_HEAD)} || DESCRIPTION || {_part(chr(10) + 'Vendor: ', 'VENDOR_NAME')} || "
        f"{_part(chr(10) + 'Category: ', 'CATEGORY')} || {_part(chr(10) + 'Subcategory: ', 'SUBCATEGORY')} || "
        f"{sql_str(DESCRIPTION_PROMPT_TAIL)}"
    )
    q.add(f"{prefix}2", f"SELECT *, CASE WHEN _desc_src = 'residual' THEN {ctx} END AS _desc_ctx FROM {prefix}1")
    return q.add(f"{prefix}3", f"SELECT *, {rid_sql('description', '_desc_ctx')} AS _desc_rid FROM {prefix}2")


def resolve_attempts_sql(q: Sql, attempts: str, name: str = "resolved") -> str:
    q.add(
        f"{name}_a",
        f"SELECT *, (responded AND response IS NOT NULL) AS ok, coalesce(error, {sql_str(EMPTY_RESPONSE_ERROR)}) AS err "
        f"FROM {attempts} WHERE attempt <= {MAX_ATTEMPTS}",
    )
    q.add(
        f"{name}_g",
        f"SELECT request_id, min(attempt) FILTER (WHERE ok) AS ok_attempt, max(attempt) AS last_attempt, "
        f"count(*) AS attempts FROM {name}_a GROUP BY request_id",
    )
    q.add(
        f"{name}_u",
        f"SELECT a.request_id, count(*) FILTER (WHERE a.responded AND a.attempt <= coalesce(g.ok_attempt, {MAX_ATTEMPTS})) AS responses, "
        f"CAST(coalesce(sum(coalesce(a.total_tokens, 0)) FILTER (WHERE a.responded AND a.attempt <= coalesce(g.ok_attempt, {MAX_ATTEMPTS})), 0) AS BIGINT) AS tokens "
        f"FROM {name}_a a JOIN {name}_g g ON a.request_id = g.request_id GROUP BY a.request_id",
    )
    return q.add(
        name,
        f"SELECT g.request_id, CASE WHEN g.ok_attempt IS NOT NULL THEN {clean_description_sql('okr.response')} "
        f"WHEN g.last_attempt = {MAX_ATTEMPTS} THEN {sql_str(DESCRIPTION_ERROR_PREFIX)} || lst.err END AS description, g.ok_attempt, g.attempts, "
        f"u.responses, u.tokens "
        f"FROM {name}_g g JOIN {name}_u u ON g.request_id = u.request_id "
        f"LEFT JOIN {name}_a okr ON okr.request_id = g.request_id AND okr.attempt = g.ok_attempt "
        f"JOIN {name}_a lst ON lst.request_id = g.request_id AND lst.attempt = g.last_attempt",
    )


def description_label(q: Sql, traced: str, resolved: str | None, prior: str | None = None, prefix: str = "d") -> str:
    if resolved:
        q.add(f"{prefix}4", f"SELECT t.*, r.description AS _desc_ans FROM {traced} t LEFT JOIN {resolved} r ON t._desc_rid = r.request_id")
        ans = "_desc_ans"
        src = f"{prefix}4"
    else:
        ans = "CAST(NULL AS VARCHAR)"
        src = traced
    pr = prior or "CAST(NULL AS VARCHAR)"
    label = f"CASE _desc_src WHEN 'skipped' THEN {pr} WHEN 'blank' THEN {sql_str(NO_DESCRIPTION)} ELSE {ans} END"
    if prior:
        return q.add(f"{prefix}5", f"SELECT * REPLACE ({label} AS {prior}) FROM {src}")
    return q.add(f"{prefix}5", f"SELECT *, {label} AS {SD} FROM {src}")


def percent_expr(count: str, total: str) -> str:
    return f"(CAST({count} AS DOUBLE) / CAST({total} AS DOUBLE)) * 100e0"


def cost_expr(tokens: str) -> str:
    return f"(CAST({tokens} AS DOUBLE) / 1000e0) * CAST({COST_PER_1K_TOKENS!r} AS DOUBLE)"
