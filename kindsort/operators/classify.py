"""Classifiers C1-C9 as Column expressions over one Project (no shuffle).

Every stage adds its output column and, with ``trace=True``, the columns that
say what decided each row (``_<stage>_src``), the deciding keyword, and the
model request a residual row would send (``_<stage>_ctx``/``_<stage>_rid``).
Answers come in as a ``completions`` table ``(request_id, response)``; a
residual row without an answer falls back to ``Needs Review`` so the engine is
total and deterministic without any network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matcher import ENGINE, match_columns
from ..functions.rulejoin import labels_by_table
from ..functions.rules import any_match, first_match_keyword, keyword_label
from ..functions.text import blank, normalize_label, normalize_yes_no, present
from ..functions.vocab import (
    CATEGORY_COL,
    CATEGORY_LABELS,
    CATEGORY_RULES,
    DISTRICT,
    DISTRICT_KEYWORDS,
    FACILITY_COL,
    FACILITY_LABELS,
    NEEDS_REVIEW,
    NO_DESCRIPTION,
    REVIEW_KEYWORDS,
    RURAL,
    RURAL_KEYWORDS,
    BOTH,
    SIMPLE_DESC_COL,
    UNCATEGORIZED,
    YES,
)
from ..session import stored as written

LOWER_DESC = "_d"
# mark of the columns that hold a description's matches: they are computed once and reused
MATCHED = {"kindsort": "match"}
REQUEST_SEP = "\u0001"

# Our own wording of the description request (the request text is ours).
DESCRIPTION_PROMPT_HEAD = (
    "Write a one-line, plain-language description of this medical inventory item "
    "for a reader without medical training.\n\nItem: "
)
DESCRIPTION_PROMPT_TAIL = (
    "\n\nKeep it under 15 words, say what the item is and what it is for, use short "
    "common abbreviations and standard units, leave out brand names unless needed, "
    "and reply with the description only."
)


def opt_col(df: DataFrame, name: str, default: str | None = None) -> Column:
    """P5: the column if the table has it, else a typed constant default."""
    if name in df.columns:
        return F.col(f"`{name}`")
    return F.lit(default).cast("string")


#: How a request id is spelled.
DIGEST = "^[0-9a-f]{64}$"


def request_id(stage: str, context: Column) -> Column:
    """Stable id of a model request: sha-256 of stage and request text."""
    return F.sha2(F.concat_ws(REQUEST_SEP, F.lit(stage), context), 256)


def _part(prefix: str, c: Column) -> Column:
    return F.when(present(c), F.concat(F.lit(prefix), c)).otherwise(F.lit(""))


def category_context(df: DataFrame) -> Column:
    """The category request text."""
    return F.concat(F.lit("Description: "), opt_col(df, "DESCRIPTION", ""), _part(", Vendor: ", opt_col(df, "VENDOR_NAME")), _part(", Subcategory: ", opt_col(df, "SUBCATEGORY")))


def facility_context(df: DataFrame, category_col: str = CATEGORY_COL) -> Column:
    """The facility request text."""
    return F.concat(F.lit("Description: "), opt_col(df, "DESCRIPTION", ""), _part(", Category: ", opt_col(df, category_col)), _part(", Vendor: ", opt_col(df, "VENDOR_NAME")))


#: The input's columns, and the label, that request texts are made of.
TEXT_COLS = ("DESCRIPTION", "VENDOR_NAME", "CATEGORY", "SUBCATEGORY", CATEGORY_COL)


def with_request(traced: DataFrame, stage: str) -> DataFrame:
    """Rows of :func:`categorize`, :func:`facility` or :func:`describe` that were written without
    the text or the id of the request that an open row sends, with both.

    They are worked out again of the row's own ``TEXT_COLS``, which must be there."""
    prefix, context = {"category": ("_cat", category_context), "facility": ("_fac", facility_context), "description": ("_desc", description_context)}[stage]
    ctx, rid, open_row = f"{prefix}_ctx", f"{prefix}_rid", F.col(f"{prefix}_src") == "residual"
    x = traced if ctx in traced.columns else traced.withColumn(ctx, F.when(open_row, context(traced)))
    return x if rid in x.columns else x.withColumn(rid, F.when(open_row, request_id(stage, F.col(ctx))))


def with_lower_description(df: DataFrame) -> DataFrame:
    """Lower-case the description once; every matcher reads this column."""
    if LOWER_DESC in df.columns and df.schema[LOWER_DESC].metadata == MATCHED:
        return df
    return df.withColumn(LOWER_DESC, F.lower(opt_col(df, "DESCRIPTION", "")).alias(LOWER_DESC, metadata=MATCHED))


MATCH_COLS = ["_cat_kw", "_fac_review", "_fac_rural", "_fac_district"]


def with_matches(df: DataFrame, engine: str = ENGINE) -> DataFrame:
    """All description vocabularies matched once: ``_cat_kw`` (first category
    keyword) and the ``_fac_review/_fac_rural/_fac_district`` flags.

    Computed once and reused by every stage of a pipeline (the columns stay
    until the trace columns are dropped)."""
    if all(c in df.columns and df.schema[c].metadata == MATCHED for c in MATCH_COLS):
        return df
    x = with_lower_description(df)
    cols = match_columns(
        F.col(LOWER_DESC),
        {"category": CATEGORY_RULES},
        {"review": REVIEW_KEYWORDS, "rural": RURAL_KEYWORDS, "district": DISTRICT_KEYWORDS},
        engine,
    )
    if "__struct__" in cols:
        x = x.withColumn("_match", cols["__struct__"])
        get = {
            "_cat_kw": F.col("_match.category"),
            "_fac_review": F.col("_match.review"),
            "_fac_rural": F.col("_match.rural"),
            "_fac_district": F.col("_match.district"),
        }
    else:
        get = {"_cat_kw": cols["category"], "_fac_review": cols["review"], "_fac_rural": cols["rural"], "_fac_district": cols["district"]}
    return x.select(*(f"`{c}`" for c in x.columns if c not in MATCH_COLS), *(get[c].alias(c, metadata=MATCHED) for c in MATCH_COLS))


def one_answer(completions: DataFrame) -> DataFrame:
    """L3: one ``(request_id, response)`` for each request.

    Of several answers the one of the latest ``batch_id`` (if the table has
    one) stays, and among equals the largest text; a missing text stays only
    where there is no other."""
    batch = F.col("batch_id") if "batch_id" in completions.columns else F.lit(0)
    rank = F.struct(F.col("response").isNotNull(), batch, F.col("response"))
    return completions.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.max_by("response", rank).alias("response"))


def _answers(completions: DataFrame | None, stage_rid: str, norm) -> tuple[DataFrame | None, str]:
    if completions is None:
        return None, ""
    ans = one_answer(completions).select(F.col("request_id").alias(stage_rid + "_k"), norm(F.col("response")).alias(stage_rid + "_a"))
    return ans, stage_rid + "_a"


# largest answer table (rows, characters) that every task gets whole
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 16_000_000


def _join_answers(df: DataFrame, ans: DataFrame, rid: str, stored: bool = False) -> DataFrame:
    """The rows with their answers; rows that no request left open are not shuffled.

    The answer table is written once and measured.  Up to ``BROADCAST_ROWS`` and
    ``BROADCAST_CHARS`` every task gets it and no row moves.  A larger one is
    joined by shuffle with the open rows alone: the rows are written once, so the
    rules run once for both parts, and the decided rows pass beside the join.  Ids are
    shuffled as the bytes of the digest; an answer whose id is none has no row.  A
    request id shared by many rows is split by AQE's skew handling.  ``stored`` rows
    are written already and not once more."""
    key, a = rid + "_k", rid + "_a"
    ans = written(ans, "answers")
    rows, chars = ans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(a)), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS:
        return df.join(F.broadcast(ans), df[rid] == ans[key], "left").drop(key)
    x = df if stored else written(df, "rows")
    columns, packed = [F.col(f"`{c}`") for c in x.columns], f"{rid}_p"
    given = ans.where(F.col(key).rlike(DIGEST)).withColumn(key, F.unhex(key))
    waiting = x.where(F.col(rid).isNotNull()).withColumn(packed, F.unhex(rid)).drop(rid)
    still = waiting.join(given.hint("shuffle_merge"), F.col(packed) == F.col(key), "left").withColumn(rid, F.lower(F.hex(packed)))
    return x.where(F.col(rid).isNull()).withColumn(a, F.lit(None).cast("string")).unionByName(still.select(*columns, a))


def _with_answers(df: DataFrame, completions, rid: str, norm, stored: bool = False) -> tuple[DataFrame, str]:
    """``df`` with the normalised answer to ``rid`` as a further column, and its name ("" without completions).

    In an answer store the open rows look theirs up; for that, rows that are not stored
    yet are written once, and the decided ones pass beside."""
    if completions is None:
        return df, ""
    ans_col = f"{rid}_a"
    if not hasattr(completions, "look_up"):
        ans, _ = _answers(completions, rid, norm)
        return _join_answers(df, ans, rid, stored), ans_col
    x = df if stored else written(df, "rows")
    waiting = completions.look_up(x.where(F.col(rid).isNotNull()), rid, ans_col)
    waiting = waiting.withColumn(ans_col, norm(F.col(ans_col)))
    return x.where(F.col(rid).isNull()).withColumn(ans_col, F.lit(None).cast("string")).unionByName(waiting), ans_col


def apply_answers(stored: DataFrame, stage: str, completions) -> DataFrame:
    """L3 on rows that were traced and written before: only the labels of open rows are looked at again.

    ``stored``: output of :func:`categorize` or :func:`facility` with ``trace=True``, written
    or checkpointed; the rules, request texts and ids are not worked out a second time.
    ``completions``: a table of answers, or an :class:`kindsort.sinks.store.AnswerStore`,
    in which the open rows look theirs up.  All columns stay, the stage's label is filled in."""
    prefix, label, norm = {
        "category": ("_cat", CATEGORY_COL, lambda r: normalize_label(r, CATEGORY_LABELS)),
        "facility": ("_fac", FACILITY_COL, lambda r: normalize_label(r, FACILITY_LABELS)),
        "electricity": ("_ele", ELECTRICITY_COL, normalize_yes_no),
    }[stage]
    rid = f"{prefix}_rid"
    rows = stored.drop(f"{rid}_a")
    x, ans_col = _with_answers(rows, completions, rid, norm, stored=True)
    told = F.when(F.col(f"{prefix}_src") == "residual", F.coalesce(F.col(ans_col), F.lit(NEEDS_REVIEW))).otherwise(F.col(f"`{label}`"))
    return x.withColumn(label, F.coalesce(told, F.lit(NEEDS_REVIEW))).select(*(F.col(f"`{c}`") for c in rows.columns), ans_col)


def _finish(df: DataFrame, helpers: list[str], trace: bool, given: list[str] | None = None) -> DataFrame:
    """Drop the helper columns this stage added (columns the caller passed in stay)."""
    if trace:
        return df
    keep = set(given or [])
    return df.drop(*[h for h in helpers if h and h in df.columns and h not in keep])


# --- C1..C4: product category ------------------------------------------------------

def categorize(
    df: DataFrame,
    preserve_existing: bool = True,
    completions: DataFrame | None = None,
    trace: bool = False,
    engine: str = ENGINE,
    contexts: bool = True,
) -> DataFrame:
    """C3 product category with P6 preserve, C1/C2 rules, L3 answers and C4 trace.

    ``completions``: a table of answers or an answer store (in every stage).  Without
    ``contexts`` the texts of the requests, the widest trace column, stay out."""
    d = opt_col(df, "DESCRIPTION", "")
    s = opt_col(df, "SUBCATEGORY")
    existing = opt_col(df, CATEGORY_COL) if preserve_existing else F.lit(None).cast("string")
    x = with_matches(df, engine)
    # lower-cased once, not for every keyword
    lower = next(c for c in (f"_cat_sub_{i}" for i in range(len(x.columns) + 1)) if c.lower() not in {n.lower() for n in x.columns})
    x = x.withColumn(lower, F.lower(s))
    x = x.withColumn(
        "_cat_subkw",
        F.when(F.col("_cat_kw").isNull() & present(s), first_match_keyword(F.col(lower), CATEGORY_RULES)),
    ).drop(lower)
    src = (
        F.when(present(existing), F.lit("preserved"))
        .when(blank(d), F.lit("blank"))
        .when(F.col("_cat_kw").isNotNull(), F.lit("description"))
        .when(F.col("_cat_subkw").isNotNull(), F.lit("subcategory"))
        .otherwise(F.lit("residual"))
    )
    x = x.withColumn("_cat_src", src)
    resid = F.col("_cat_src") == "residual"
    x = x.withColumn("_cat_ctx", F.when(resid, category_context(df))).withColumn(
        "_cat_rid", F.when(resid, request_id("category", F.col("_cat_ctx")))
    )
    if not contexts:
        x = x.drop("_cat_ctx")
    x, ans_col = _with_answers(x, completions, "_cat_rid", lambda r: normalize_label(r, CATEGORY_LABELS))
    if ans_col:
        answered = F.coalesce(F.col(ans_col), F.lit(NEEDS_REVIEW))
    else:
        answered = F.lit(NEEDS_REVIEW)
    label = (
        F.when(F.col("_cat_src") == "preserved", existing)
        .when(F.col("_cat_src") == "blank", F.lit(UNCATEGORIZED))
        .when(F.col("_cat_src") == "description", keyword_label(F.col("_cat_kw"), CATEGORY_RULES))
        .when(F.col("_cat_src") == "subcategory", keyword_label(F.col("_cat_subkw"), CATEGORY_RULES))
        .otherwise(answered)
    )
    # never null (a preserved value is non-blank): lets the optimizer drop
    # IS NOT NULL tests on the label instead of pushing them into the scan
    x = x.withColumn(CATEGORY_COL, F.coalesce(label, F.lit(NEEDS_REVIEW)))
    helpers = [LOWER_DESC, "_match", *MATCH_COLS, "_cat_subkw", "_cat_src", "_cat_ctx", "_cat_rid", ans_col]
    return _finish(x, helpers, trace, df.columns)


def keyword_category(df: DataFrame, engine: str = ENGINE) -> DataFrame:
    """C1 alone: first description keyword and its label (null when none)."""
    x = with_matches(df, engine)
    x = x.withColumn("keyword", F.col("_cat_kw")).withColumn("label", keyword_label(F.col("keyword"), CATEGORY_RULES))
    return x.drop(LOWER_DESC, "_match", *MATCH_COLS)


# --- C5, C6: facility suitability --------------------------------------------------

def facility_flags(df: DataFrame, engine: str = ENGINE) -> DataFrame:
    """Any-match flags for the three facility vocabularies (null text -> null)."""
    return with_matches(df, engine)


def facility(
    df: DataFrame,
    completions: DataFrame | None = None,
    category_col: str = CATEGORY_COL,
    trace: bool = False,
    engine: str = ENGINE,
    contexts: bool = True,
) -> DataFrame:
    """Review words win; then the rural x district truth table; then answers.

    The column is always recomputed (never preserved)."""
    d = opt_col(df, "DESCRIPTION", "")
    x = facility_flags(df, engine)
    rv, ru, di = F.col("_fac_review"), F.col("_fac_rural"), F.col("_fac_district")
    src = (
        F.when(blank(d), F.lit("blank"))
        .when(rv, F.lit("review"))
        .when(ru | di, F.lit("rule"))
        .otherwise(F.lit("residual"))
    )
    x = x.withColumn("_fac_src", src)
    resid = F.col("_fac_src") == "residual"
    x = x.withColumn("_fac_ctx", F.when(resid, facility_context(df, category_col))).withColumn(
        "_fac_rid", F.when(resid, request_id("facility", F.col("_fac_ctx")))
    )
    if not contexts:
        x = x.drop("_fac_ctx")
    x, ans_col = _with_answers(x, completions, "_fac_rid", lambda r: normalize_label(r, FACILITY_LABELS))
    if ans_col:
        answered = F.coalesce(F.col(ans_col), F.lit(NEEDS_REVIEW))
    else:
        answered = F.lit(NEEDS_REVIEW)
    label = (
        F.when(F.col("_fac_src").isin("blank", "review"), F.lit(NEEDS_REVIEW))
        .when(ru & di, F.lit(BOTH))
        .when(ru, F.lit(RURAL))
        .when(di, F.lit(DISTRICT))
        .otherwise(answered)
    )
    x = x.withColumn(FACILITY_COL, F.coalesce(label, F.lit(NEEDS_REVIEW)))
    helpers = [LOWER_DESC, "_match", *MATCH_COLS, "_fac_src", "_fac_ctx", "_fac_rid", ans_col]
    return _finish(x, helpers, trace, df.columns)


# --- C7: electricity requirement -----------------------------------------------------

ELECTRICITY_COL = "Requires Electricity"


def electricity(
    df: DataFrame,
    vocabulary: list[str],
    completions: DataFrame | None = None,
    category_col: str = CATEGORY_COL,
    trace: bool = False,
) -> DataFrame:
    """Blank -> Needs Review; any vocabulary word -> Yes; else yes/no answer.

    The vocabulary is a required argument (none ships with the rules)."""
    if not vocabulary:
        raise ValueError("electricity needs a non-empty vocabulary")
    d = opt_col(df, "DESCRIPTION", "")
    cat = opt_col(df, category_col)
    x = with_lower_description(df)
    x = x.withColumn("_ele_hit", any_match(F.col(LOWER_DESC), [w.lower() for w in vocabulary]))
    src = F.when(blank(d), F.lit("blank")).when(F.col("_ele_hit"), F.lit("rule")).otherwise(F.lit("residual"))
    x = x.withColumn("_ele_src", src)
    resid = F.col("_ele_src") == "residual"
    ctx = F.concat(F.lit("Description: "), d, _part(", Category: ", cat))
    x = x.withColumn("_ele_ctx", F.when(resid, ctx)).withColumn(
        "_ele_rid", F.when(resid, request_id("electricity", F.col("_ele_ctx")))
    )
    x, ans_col = _with_answers(x, completions, "_ele_rid", normalize_yes_no)
    if ans_col:
        answered = F.coalesce(F.col(ans_col), F.lit(NEEDS_REVIEW))
    else:
        answered = F.lit(NEEDS_REVIEW)
    label = (
        F.when(F.col("_ele_src") == "blank", F.lit(NEEDS_REVIEW))
        .when(F.col("_ele_src") == "rule", F.lit(YES))
        .otherwise(answered)
    )
    x = x.withColumn(ELECTRICITY_COL, label)
    return _finish(x, [LOWER_DESC, "_ele_hit", "_ele_src", "_ele_ctx", "_ele_rid", ans_col], trace, df.columns)


# --- C8: simple description ------------------------------------------------------------

def description_context(df: DataFrame) -> Column:
    """The description request text (blank parts left out)."""
    d = opt_col(df, "DESCRIPTION", "")
    return F.concat(
        F.lit(DESCRIPTION_PROMPT_HEAD),
        d,
        _part("\nVendor: ", opt_col(df, "VENDOR_NAME")),
        _part("\nCategory: ", opt_col(df, "CATEGORY")),
        _part("\nSubcategory: ", opt_col(df, "SUBCATEGORY")),
        F.lit(DESCRIPTION_PROMPT_TAIL),
    )


def describe(
    df: DataFrame,
    resolved: DataFrame | None = None,
    first_n: int | None = None,
    row_col: str = "_row",
    trace: bool = False,
    contexts: bool = True,
) -> DataFrame:
    """C8 simple description.

    ``resolved`` is the output of :func:`kindsort.operators.enrich.resolve_attempts`
    ``(request_id, description, ...)``.  Blank -> ``No description available``;
    a request that is to be tried (again) stays null (pending).  With ``first_n``
    (L6) only rows with ``row_col < first_n`` get a value (a null position is none of them); the others keep a
    prior value of the column, or null.
    """
    d = opt_col(df, "DESCRIPTION", "")
    prior = opt_col(df, SIMPLE_DESC_COL)
    src = F.when(blank(d), F.lit("blank")).otherwise(F.lit("residual"))
    if first_n is not None and first_n > 0:
        src = F.when(F.coalesce(F.col(row_col) >= F.lit(first_n), F.lit(True)), F.lit("skipped")).otherwise(src)
    x = df.withColumn("_desc_src", src)
    resid = F.col("_desc_src") == "residual"
    x = x.withColumn("_desc_ctx", F.when(resid, description_context(df))).withColumn(
        "_desc_rid", F.when(resid, request_id("description", F.col("_desc_ctx")))
    )
    if not contexts:
        x = x.drop("_desc_ctx")
    if resolved is not None:
        ans = resolved.select(F.col("request_id").alias("_desc_rid_k"), F.col("description").alias("_desc_rid_a"))
        x = _join_answers(x, ans, "_desc_rid")
        answered = F.col("_desc_rid_a")
    else:
        answered = F.lit(None).cast("string")
    value = (
        F.when(F.col("_desc_src") == "skipped", prior)
        .when(F.col("_desc_src") == "blank", F.lit(NO_DESCRIPTION))
        .otherwise(answered)
    )
    x = x.withColumn(SIMPLE_DESC_COL, value)
    return _finish(x, ["_desc_src", "_desc_ctx", "_desc_rid", "_desc_rid_a"], trace, df.columns)


# --- C9: components an item needs ------------------------------------------------------

COMPONENTS_COL = "components"


def component_flags(df: DataFrame, rules: list[tuple[str, str]] | DataFrame, out: str = COMPONENTS_COL) -> DataFrame:
    """Components an item needs by ``(keyword, component)`` rules.

    A sorted comma list in ``out``; null when no keyword is found or the text is null.
    Rules in a table (``keyword, component``), of any number, are joined by gram; a list
    becomes one expression."""
    text = F.lower(opt_col(df, "DESCRIPTION", ""))
    if isinstance(rules, DataFrame):
        lower = next(c for c in (f"{LOWER_DESC}_{i}" for i in range(len(df.columns) + 1)) if c.lower() not in {x.lower() for x in df.columns})
        return labels_by_table(df.withColumn(lower, text), lower, rules.withColumnRenamed("component", "label"), out).drop(lower)
    by: dict[str, list[str]] = {}
    for keyword, component in rules:
        by.setdefault(component, []).append(keyword.lower())
    parts = [F.when(any_match(text, by[c]), F.lit(c)) for c in sorted(by)]
    return df.withColumn(out, F.nullif(F.concat_ws(", ", *parts), F.lit("")))
