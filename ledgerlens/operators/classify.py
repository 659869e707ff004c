"""Rule classifier (D4-D18) as generated column expressions.

The rule table is configuration (tens of rules, about a hundred patterns), so
it is compiled on the driver into plain Catalyst expressions:

1. the nine feature columns, NULL/absent -> '', stripped and lower-cased;
2. per rule: article evidence, vendor evidence, keyword list and score, and
   the first matching vendor / article pattern as written;
3. the winner: first article rule by priority, else first vendor rule, else
   the keyword rule with the highest score (ties by priority); its target,
   confidence, bucket, review flag and explanations.

Everything is row-local: no join, no shuffle, no Python; it runs inside one
narrow stage (and works unchanged on a streaming frame).
Semantics follow the studied engine exactly, including its quirks: the
match type is not interpreted (every condition is a substring test), the
conditions of one tier are OR-ed, an article hit beats any vendor hit, rules
whose conditions are all '*' are skipped, and conditions on the project and
department columns never count as evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import config as cfg
from ledgerlens.functions.text import ustrip
from ledgerlens.session import written
from ledgerlens.sources.ingest import ROW_SEQ

CLASSIFICATION_OUTPUT_COLUMNS = [
    "l1_category",
    "l2_category",
    "l3_category",
    "classification_reason",
    "classification_reason_human",
    "classification_confidence",
    "classification_confidence_score",
    "classification_rule_id",
    "matched_rule_id",
    "matched_keywords",
    "matched_vendor_pattern",
    "matched_article_pattern",
    "review_required",
]


def _norm_text(value: Any) -> str:
    return str(value).strip().lower()


def is_wildcard_fallback(rule: dict[str, Any]) -> bool:
    """Every condition lists only '*' (after strip/lower)."""
    conditions = rule.get("conditions") or []
    if not conditions:
        return False
    return all({_norm_text(v) for v in c.get("values", [])} == {"*"} for c in conditions)


def active_rules(rules: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Rules in evaluation order: stable sort by priority, fallbacks removed."""
    ordered = sorted(enumerate(rules), key=lambda item: (int(item[1]["priority"]), item[0]))
    return [rule for _, rule in ordered if not is_wildcard_fallback(rule)]


@dataclass
class _Compiler:
    """Collects distinct substring tests as named columns."""

    tests: dict[tuple[str, str], str] = field(default_factory=dict)

    def hit(self, feature: str, text: str) -> Column:
        key = (feature, text)
        if key not in self.tests:
            self.tests[key] = f"__h{len(self.tests)}"
        return F.col(self.tests[key])


def _feature_name(column: str) -> str:
    return f"__f_{cfg.FEATURE_COLUMNS.index(column)}"


def _any(cols: list[Column]) -> Column:
    if not cols:
        return F.lit(False)
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def _tier_match(comp: _Compiler, rule: dict[str, Any], columns: list[str]) -> Column:
    """Matcher: any condition on ``columns`` with raw '*' or lower(pattern) contained."""
    parts = []
    for cond in rule["conditions"]:
        if cond["column"] not in columns:
            continue
        values = [str(v) for v in cond["values"]]
        if "*" in values:
            return F.lit(True)
        parts.extend(comp.hit(cond["column"], v.lower()) for v in values)
    return _any(parts)


def _keywords(rule: dict[str, Any]) -> list[str]:
    """Keyword candidates: stripped/lower patterns of conditions on the three
    text columns, blanks and '*' dropped, first occurrence kept."""
    out: list[str] = []
    for cond in rule["conditions"]:
        if cond["column"] not in cfg.KEYWORD_COLUMNS:
            continue
        for v in cond["values"]:
            k = _norm_text(v)
            if k and k != "*" and k not in out:
                out.append(k)
    return out


def _keyword_parts(comp: _Compiler, rule: dict[str, Any]) -> tuple[Column, Column]:
    """(matched keyword array in order, keyword score)."""
    kws = _keywords(rule)
    if not kws:
        return F.array().cast("array<string>"), F.lit(0.0)
    per_field = {
        col: [comp.hit(col, k) for k in kws] for col in cfg.KEYWORD_COLUMNS
    }
    matched = [
        F.when(_any([per_field[col][i] for col in cfg.KEYWORD_COLUMNS]), F.lit(k))
        for i, k in enumerate(kws)
    ]
    keyword_array = F.filter(F.array(*matched), lambda x: x.isNotNull())
    score = F.lit(0.0)
    for col in cfg.KEYWORD_COLUMNS:
        score = score + F.when(_any(per_field[col]), F.lit(cfg.KEYWORD_WEIGHTS[col])).otherwise(F.lit(0.0))
    return keyword_array, F.least(score, F.lit(1.0))


def _features(df: DataFrame) -> dict[str, Column]:
    """The nine features, NULL/absent -> '', stripped and lower-cased."""
    features = {}
    for column in cfg.FEATURE_COLUMNS:
        raw = F.col(column).cast("string") if column in df.columns else F.lit(None).cast("string")
        features[_feature_name(column)] = F.lower(ustrip(F.coalesce(raw, F.lit(""))))
    return features


def classification_input(df: DataFrame) -> DataFrame:
    """The row number and the nine feature columns as texts; NULL or absent -> ''."""
    return df.select(
        *([F.col(ROW_SEQ)] if ROW_SEQ in df.columns else []),
        *[
            (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c)
            for c in cfg.FEATURE_COLUMNS
        ],
    )


def sql_str(value: str) -> str:
    """Spark SQL string literal (backslash escapes, control and space chars as \\uXXXX)."""
    out = []
    for ch in str(value):
        if ch == "\\":
            out.append("\\\\")
        elif ch == "'":
            out.append("\\'")
        elif ord(ch) < 32 or (ch.isspace() and ch != " "):
            out.append(f"\\u{ord(ch):04x}")
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def _dbl(value: float) -> str:
    return f"{float(value)!r}D"


def _sql_or(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")" if parts else "false"


class _SqlCompiler:
    """Substring tests as SQL text, each run only where its branch is reached."""

    def hit(self, feature: str, text: str) -> str:
        return f"contains({_feature_name(feature)}, {sql_str(text)})"


def _sql_tier(comp: _SqlCompiler, rule: dict[str, Any], columns: list[str], strict: bool = False) -> str:
    parts = []
    for cond in rule["conditions"]:
        if cond["column"] not in columns:
            continue
        values = [str(v) for v in cond["values"]]
        if "*" in values:
            return "true"
        mtype = cond.get("match_type", "contains_any")
        feature = _feature_name(cond["column"])
        if strict and mtype in ("equals_any", "in_list"):
            parts.append(f"{feature} IN ({', '.join(sql_str(v.lower()) for v in values)})")
        elif strict and mtype == "regex_any":
            parts.extend(f"regexp_like({feature}, {sql_str(v)})" for v in values)
        else:
            parts.extend(comp.hit(cond["column"], v.lower()) for v in values)
    return _sql_or(parts)


def _sql_first_pattern(comp: _SqlCompiler, rule: dict[str, Any], columns: list[str]) -> str:
    branches = []
    for cond in rule["conditions"]:
        if cond["column"] not in columns:
            continue
        for v in cond["values"]:
            v = str(v)
            normalized = _norm_text(v)
            if normalized == "*":
                branches.append(("true", v))
                break
            branches.append((comp.hit(cond["column"], normalized), v))
    if not branches:
        return "CAST(NULL AS STRING)"
    return "CASE " + " ".join(f"WHEN {c} THEN {sql_str(v)}" for c, v in branches) + " END"


def _sql_keywords(comp: _SqlCompiler, rule: dict[str, Any]) -> tuple[str, str]:
    kws = _keywords(rule)
    if not kws:
        return "''", "0.0D"
    per_field = {col: [comp.hit(col, k) for k in kws] for col in cfg.KEYWORD_COLUMNS}
    matched = [
        f"CASE WHEN {_sql_or([per_field[col][i] for col in cfg.KEYWORD_COLUMNS])} THEN {sql_str(k)} END"
        for i, k in enumerate(kws)
    ]
    text = f"concat_ws(', ', {', '.join(matched)})"
    score = "0.0D"
    for col in cfg.KEYWORD_COLUMNS:
        score = f"({score} + CASE WHEN {_sql_or(per_field[col])} THEN {_dbl(cfg.KEYWORD_WEIGHTS[col])} ELSE 0.0D END)"
    return text, f"least({score}, 1.0D)"


#: NULL to all but the optimizer: functions.text.in_own_methods as SQL text, for projections of rule tests.
_NOTHING = f"get(filter(array({_feature_name(cfg.FEATURE_COLUMNS[0])}), x -> length(x) < 0), 0)"


def _sql_apart(value: str, dtype: str = "STRING") -> str:
    return f"coalesce({value}, try_cast({_NOTHING} AS {dtype}))"


def _sql_pick(values: list[str], index: str = "__w") -> str:
    if not values:
        return "NULL"
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def classify_payments(
    df: DataFrame,
    rules: list[dict[str, Any]] | None = None,
    strict_match_types: bool = False,
) -> DataFrame:
    """Append the 13 classification columns to every row.

    ``strict_match_types=False`` (default) reproduces the studied engine, where
    every condition is a substring test whatever its match type; ``True``
    honours equals_any / in_list (whole value) and regex_any (regex) for the
    article and vendor tiers.

    Plan shape: Project(features) -> Project(first article rule) -> Project(first
    vendor rule, where there is none) -> Project(best keyword rule, where there is
    neither) -> Generate(inline of one struct: winner, its evidence and confidence)
    -> Project(its target, keywords and patterns) -> Project(the 13 outputs).  Tests
    sit in CASE branches, so most rows stop at the first rule that matches.  The
    one-row ``inline`` keeps later filters on the outputs (review queue, unmatched
    rows) above the rule expressions instead of letting the optimizer copy those
    into the filter; texts that nobody reads are pruned.  The expressions are generated
    as SQL text (a few parser calls instead of thousands of Column calls).
    """
    rules = cfg.CLASSIFICATION_RULES if rules is None else rules
    ordered = active_rules(rules)
    comp = _SqlCompiler()
    original = df.columns
    staged = df.withColumns(_features(df))

    art, ven, kw_texts, kw_scores, vpat, apat = [], [], [], [], [], []
    for rule in ordered:
        art.append(_sql_tier(comp, rule, cfg.ARTICLE_COLUMNS, strict_match_types))
        ven.append(_sql_tier(comp, rule, cfg.VENDOR_COLUMNS, strict_match_types))
        text, score = _sql_keywords(comp, rule)
        kw_texts.append(text)
        kw_scores.append(score)
        vpat.append(_sql_first_pattern(comp, rule, cfg.VENDOR_COLUMNS))
        apat.append(_sql_first_pattern(comp, rule, cfg.ARTICLE_COLUMNS))

    n = len(ordered)

    def first(tests: list[str]) -> str:
        return "CASE " + " ".join(f"WHEN {test} THEN {i}" for i, test in enumerate(tests)) + " END" if n else "CAST(NULL AS INT)"

    best = ", ".join(f"named_struct('s', -{score}, 'i', {i})" for i, score in enumerate(kw_scores))
    best = f"array_min(array({best}))" if n else "CAST(NULL AS STRUCT<s: DOUBLE, i: INT>)"
    wa = _sql_apart(first(art), "INT")
    staged = staged.selectExpr("*", f"{wa} AS __wa", f"CASE WHEN {wa} IS NULL THEN {first(ven)} END AS __wv")
    staged = staged.selectExpr("*", f"CASE WHEN __wa IS NULL AND __wv IS NULL AND {_NOTHING} IS NULL THEN {best} END AS __wk")
    staged = staged.selectExpr(
        "*",
        "coalesce(__wa, __wv, CASE WHEN __wk.s < 0 THEN __wk.i END) AS __w",
        "CASE WHEN __wa IS NOT NULL THEN 1 WHEN __wv IS NOT NULL THEN 2 WHEN __wk.s < 0 THEN 3 END AS __tier",
    )
    staged = staged.selectExpr(
        "*",
        "coalesce(__tier = 1, false) AS __am",
        f"coalesce(__tier = 2 OR (__tier = 1 AND {_sql_pick(ven)}), false) AS __vm",
        f"{_sql_apart(_sql_pick(kw_scores), 'DOUBLE')} AS __ks",
        f"{_sql_pick([_dbl(r['confidence']) for r in ordered])} AS __base",
    )
    number = (
        f"greatest(0.0D, least(__base + CASE WHEN __am THEN {_dbl(cfg.ARTICLE_BONUS)} ELSE 0.0D END "
        f"+ CASE WHEN __vm THEN {_dbl(cfg.VENDOR_BONUS)} ELSE 0.0D END + __ks * {_dbl(cfg.KEYWORD_FACTOR)}, 1.0D))"
    )
    staged = staged.selectExpr("*", f"{number} AS __num")
    winner = "named_struct('__w', __w, '__am', __am, '__vm', __vm, '__ks', __ks, '__num', __num)"
    kept = [f"`{c}`" for c in [*original, *[_feature_name(f) for f in cfg.FEATURE_COLUMNS]]]
    staged = staged.selectExpr(*kept, f"inline(array({winner}))")
    rrb = [_dbl(r.get("review_required_below", cfg.DEFAULT_REVIEW_REQUIRED_BELOW)) for r in ordered]
    staged = staged.selectExpr(
        "*",
        f"{_sql_apart(_sql_pick(kw_texts))} AS __kwl",
        f"{_sql_pick([sql_str(r['rule_id']) for r in ordered])} AS __rid",
        f"{_sql_pick([sql_str(r['target']['l1']) for r in ordered])} AS __l1",
        f"{_sql_pick([sql_str(r['target']['l2']) for r in ordered])} AS __l2",
        f"{_sql_pick([sql_str(r['target']['l3']) for r in ordered])} AS __l3",
        f"{_sql_pick(rrb)} AS __rrb",
        f"CASE WHEN __vm THEN {_sql_apart(_sql_pick(vpat))} END AS __vp",
        f"CASE WHEN __am THEN {_sql_apart(_sql_pick(apat))} END AS __ap",
    )
    keep = [f"`{c}`" for c in original if c not in CLASSIFICATION_OUTPUT_COLUMNS]
    return staged.selectExpr(*keep, *[f"{expr} AS {name}" for name, expr in _output_fields()])


def _text_sql(template: str, **values: str) -> str:
    """A text with {placeholders} as SQL: its literal parts and the values' expressions joined."""
    parts = [
        values[part] if i % 2 else sql_str(part) for i, part in enumerate(re.split(r"\{(\w+)\}", template)) if i % 2 or part
    ]
    return f"concat({', '.join(parts)})"


def _output_fields() -> list[tuple[str, str]]:
    """The 13 outputs as SQL over the winner's columns __w, __am, __vm, __kwl,
    __ks, __rid, __l1 .. __l3, __rrb, __vp, __ap and __num; both forms use it."""
    bucket = (
        f"CASE WHEN __num >= {_dbl(cfg.BUCKET_HIGH)} THEN 'high' WHEN __num >= {_dbl(cfg.BUCKET_MEDIUM)} THEN 'medium' "
        "WHEN __num > 0.0D THEN 'low' ELSE 'unclassified' END"
    )
    evidence = (
        "concat_ws(', ', CASE WHEN __am THEN 'article' END, CASE WHEN __vm THEN 'vendor' END, "
        "CASE WHEN __ks > 0 THEN concat('keywords=', format_number(__ks, 2)) END)"
    )
    reason = f"concat('Matched rule \\'', __rid, '\\' using ', CASE WHEN {evidence} = '' THEN 'rule fallback' ELSE {evidence} END, '.')"
    keywords = _text_sql(cfg.HUMAN_KEYWORDS, keywords="__kwl")
    human = (
        f"concat_ws(' ', {_text_sql(cfg.HUMAN_RULE, rule_id='__rid')}, "
        f"CASE WHEN __ap <> '' THEN {_text_sql(cfg.HUMAN_ARTICLE, pattern='__ap')} END, "
        f"CASE WHEN __vp <> '' THEN {_text_sql(cfg.HUMAN_VENDOR, pattern='__vp')} END, "
        f"CASE WHEN __kwl <> '' THEN {keywords} END, "
        f"{_text_sql(cfg.HUMAN_TARGET, l1='__l1', l2='__l2', l3='__l3')})"
    )
    m = "__w IS NOT NULL"
    return [
        ("l1_category", f"CASE WHEN {m} THEN __l1 ELSE {sql_str(cfg.FACT_DEFAULT_L1)} END"),
        ("l2_category", f"CASE WHEN {m} THEN __l2 ELSE {sql_str(cfg.FACT_DEFAULT_L2)} END"),
        ("l3_category", f"CASE WHEN {m} THEN __l3 ELSE {sql_str(cfg.FACT_DEFAULT_L3)} END"),
        ("classification_reason", f"CASE WHEN {m} THEN {reason} ELSE {sql_str(cfg.UNMATCHED_REASON)} END"),
        ("classification_reason_human", f"CASE WHEN {m} THEN {human} ELSE {sql_str(cfg.UNMATCHED_REASON_HUMAN)} END"),
        ("classification_confidence", f"CASE WHEN {m} THEN {bucket} ELSE 'unclassified' END"),
        ("classification_confidence_score", f"CASE WHEN {m} THEN round(__num, 4) ELSE 0.0D END"),
        ("classification_rule_id", f"CASE WHEN {m} THEN __rid END"),
        ("matched_rule_id", f"CASE WHEN {m} THEN __rid END"),
        ("matched_keywords", f"CASE WHEN {m} THEN __kwl ELSE '' END"),
        ("matched_vendor_pattern", f"CASE WHEN {m} THEN __vp END"),
        ("matched_article_pattern", f"CASE WHEN {m} THEN __ap END"),
        ("review_required", f"CASE WHEN {m} THEN ({bucket} IN ('low', 'unclassified') OR __num < __rrb) ELSE true END"),
    ]


def rule_evidence(df: DataFrame, rules: list[dict[str, Any]] | None = None) -> DataFrame:
    """D4-D7 per (row, rule): article hit, vendor hit, matched keywords, keyword score.

    Returned long: one row per input row and active rule with any evidence,
    columns (``_row_seq``, rule_id, priority, article_match, vendor_match,
    matched_keywords, keyword_score).  Built with the same compiled tests,
    then ``stack``-ed - still row-local, no join.
    """
    rules = cfg.CLASSIFICATION_RULES if rules is None else rules
    ordered = active_rules(rules)
    comp = _Compiler()
    staged = df.select("_row_seq", *[v.alias(k) for k, v in _features(df).items()])
    per_rule = []
    for rule in ordered:
        arr, score = _keyword_parts(comp, rule)
        per_rule.append(
            F.struct(
                F.lit(rule["rule_id"]).alias("rule_id"),
                F.lit(int(rule["priority"])).alias("priority"),
                _tier_match(comp, rule, cfg.ARTICLE_COLUMNS).alias("article_match"),
                _tier_match(comp, rule, cfg.VENDOR_COLUMNS).alias("vendor_match"),
                F.array_join(arr, ", ").alias("matched_keywords"),
                score.alias("keyword_score"),
            )
        )
    staged = staged.withColumns(
        {name: F.contains(F.col(_feature_name(f)), F.lit(t)) for (f, t), name in comp.tests.items()}
    )
    exploded = staged.select("_row_seq", F.explode(F.array(*per_rule)).alias("e")).select("_row_seq", "e.*")
    return exploded.where(F.col("article_match") | F.col("vendor_match") | (F.col("keyword_score") > 0))


def build_review_queue(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Low / unclassified rows in the 8-column review format; ``keep`` names further columns."""
    if "classification_confidence" not in df.columns:
        spark = df.sparkSession
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in cfg.REVIEW_COLUMNS))

    def first_of(*candidates: str) -> Column:
        for c in candidates:
            if c in df.columns:
                return F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.lit("")

    queue = df.where(F.col("classification_confidence").isin("low", "unclassified"))
    return queue.select(
        first_of("article_name", "bit_stati_oborotov_naimenovanie").alias("raw_article"),
        first_of("naznachenie_platezha").alias("raw_description"),
        first_of("vendor_name", "kontragenti_naimenovanie").alias("raw_vendor"),
        first_of("l1_category").alias("suggested_l1"),
        first_of("l2_category").alias("suggested_l2"),
        first_of("l3_category").alias("suggested_l3"),
        first_of("classification_confidence").alias("confidence"),
        first_of("classification_reason").alias("reason"),
        *([F.col("_row_seq")] if "_row_seq" in df.columns else []),
        *[F.col(c) for c in keep],
    )


def classify_with_queue(df: DataFrame, rules: list[dict[str, Any]] | None = None) -> tuple[DataFrame, DataFrame]:
    """classify + queue (with ``review_reason`` = ``reason``), both lazy."""
    classified = classify_payments(df, rules)
    queue = build_review_queue(classified)
    return classified, queue.withColumn("review_reason", F.col("reason"))


# --------------------------------------------------------------------------
# join form (large rule sets)
# --------------------------------------------------------------------------

GRAM = 3
USE_SCHEMA = "column string, needle string, rule_idx int, role string, cond_ord int, val_ord int, raw string, norm_pat string"
CONST_SCHEMA = (
    "rule_idx int, rule_id string, l1 string, l2 string, l3 string, confidence double, review_below double, "
    "art_always boolean, ven_always boolean, vpat_always struct<p: struct<cond_ord: int, val_ord: int>, raw: string>, "
    "apat_always struct<p: struct<cond_ord: int, val_ord: int>, raw: string>"
)
#: Roles of a needle: article or vendor tier; vendor or article pattern shown; keyword in one of the three text columns.
_TIER_ROLES = {"A": "art", "V": "ven"}
_PATTERN_ROLES = {"V": "vpat", "A": "apat"}


def pattern_uses(ordered: list[dict[str, Any]], strict: bool = False) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Rules as tables, bounded by the configuration: what each needle proves when a
    column's value contains it (USE_SCHEMA), what each rule holds whatever the values
    are (CONST_SCHEMA), and with ``strict`` the tests that are no containment
    (column, match type, needle, rule_idx, role).  NULL-safe: an empty needle or '*'
    needs no value, so it is a constant of its rule."""
    uses, consts, exact = [], [], []
    for idx, rule in enumerate(ordered):
        always = {"art": False, "ven": False}
        shown: dict[str, tuple | None] = {"vpat": None, "apat": None}
        for c_ord, cond in enumerate(rule["conditions"]):
            column, values = cond["column"], [str(v) for v in cond["values"]]
            kind = "A" if column in cfg.ARTICLE_COLUMNS else "V" if column in cfg.VENDOR_COLUMNS else "O"
            mtype = cond.get("match_type", "contains_any") if strict else "contains_any"
            for v_ord, v in enumerate(values):
                norm, place = _norm_text(v), (c_ord, v_ord)
                if kind != "O":
                    tier, pattern = _TIER_ROLES[kind], _PATTERN_ROLES[kind]
                    if "*" in values:
                        always[tier] = True
                    elif mtype in ("equals_any", "in_list", "regex_any"):
                        exact.append((column, mtype, v if mtype == "regex_any" else v.lower(), idx, tier))
                    elif not v.lower():
                        always[tier] = True
                    else:
                        uses.append((column, v.lower(), idx, tier, c_ord, v_ord, v, norm))
                    if norm in ("", "*"):
                        if shown[pattern] is None or place < shown[pattern][0]:
                            shown[pattern] = (place, v)
                    else:
                        uses.append((column, norm, idx, pattern, c_ord, v_ord, v, norm))
                if column in cfg.KEYWORD_COLUMNS and norm not in ("", "*"):
                    for n, keyword_column in enumerate(cfg.KEYWORD_COLUMNS):
                        uses.append((keyword_column, norm, idx, f"kw{n}", c_ord, v_ord, v, norm))
        target = rule["target"]
        consts.append((
            idx, rule["rule_id"], target["l1"], target["l2"], target["l3"], float(rule["confidence"]),
            float(rule.get("review_required_below", cfg.DEFAULT_REVIEW_REQUIRED_BELOW)),
            always["art"], always["ven"], shown["vpat"], shown["apat"],
        ))
    return uses, consts, exact


def grams_of(text: Column, size: int) -> Column:
    """The distinct substrings of so many characters."""
    n = F.length(text) - size + 1
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.when(n >= 1, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>")
    )


def containing_values(values: DataFrame, needles: DataFrame, sizes: list[int]) -> DataFrame:
    """(column, value) and (column, needle) -> (column, value, needle) where the value
    contains the needle, found by an inverted index of the values' q-grams.

    A value that contains a needle holds all its grams, so it is among those that hold
    the rarest one; only they are tested.  A needle shorter than GRAM is its own gram:
    ``sizes`` lists the gram lengths in use.  Needles are not empty."""
    text = F.col("value")
    grams = F.explode(F.array_distinct(F.concat(*[grams_of(text, n) for n in sizes]))).alias("gram")
    index = written(values.select("column", "value", grams), "grams")
    size = F.least(F.length("needle"), F.lit(GRAM))
    own = needles.select("column", "needle", F.explode(_grams_of_size(F.col("needle"), size)).alias("gram"))
    frequency = index.groupBy("column", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        own.join(frequency, ["column", "gram"], "left")
        .groupBy("column", "needle")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    )
    return index.join(rarest, ["column", "gram"]).where(F.contains("value", F.col("needle"))).select("column", "value", "needle")


def _grams_of_size(text: Column, size: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))


def _exact_hits(values: DataFrame, exact: list[tuple]) -> DataFrame:
    """Strict tests that are no containment: whole values by an equi-join, patterns row by row."""
    spark = values.sparkSession
    schema = "column string, mtype string, needle string, rule_idx int, role string"
    whole = spark.createDataFrame([x for x in exact if x[1] != "regex_any"], schema)
    hits = values.join(whole, (values["column"] == whole["column"]) & (values["value"] == whole["needle"])).select(
        values["column"], "value", "rule_idx", "role"
    )
    patterns = [x for x in exact if x[1] == "regex_any"]
    for column in sorted({x[0] for x in patterns}):
        tests = [
            F.when(F.regexp_like(F.col("value"), F.lit(p)), F.struct(F.lit(i).alias("rule_idx"), F.lit(role).alias("role")))
            for c, _, p, i, role in patterns
            if c == column
        ]
        own = values.where(F.col("column") == column)
        hits = hits.union(own.select("column", "value", F.inline(F.array_compact(F.array(*tests)))))
    return hits


def classify_payments_join(
    df: DataFrame, rules: list[dict[str, Any]] | None = None, strict_match_types: bool = False
) -> DataFrame:
    """D17, join form: same result as ``classify_payments`` for any rule count.

    1. distinct tuples of the features that some rule tests, under a 128-bit key (rows
       sharing them are classified once; a hot vendor costs one tuple, not a third of
       the data), and the distinct values of each column;
    2. values meet needles through the q-gram index of ``containing_values``;
    3. tuples take the hits of their values, and at most two rules more: the first
       ones that match any article and any vendor (later ones cannot win);
    4. per (tuple, rule): evidence, keyword list and score, first patterns;
       per tuple: winner by (tier, -score for the keyword tier, priority order);
    5. outputs joined back to the rows on the key.

    All joins are on keys; the rule tables are bounded by the configuration.
    """
    rules = cfg.CLASSIFICATION_RULES if rules is None else rules
    ordered = active_rules(rules)
    spark = df.sparkSession
    uses, consts, exact = pattern_uses(ordered, strict_match_types)
    tested = {u[0] for u in uses} | {x[0] for x in exact}
    columns = [c for c in cfg.FEATURE_COLUMNS if c in tested] or cfg.FEATURE_COLUMNS[:1]
    feats = {name: feature for name, feature in _features(df).items() if name in {_feature_name(c) for c in columns}}
    names = list(feats)
    key = ["__key1", "__key2"]
    staged = df.withColumns(feats).withColumns(
        {"__key1": F.xxhash64(*names), "__key2": F.xxhash64(F.lit("second"), *names)}
    )
    tuples = staged.groupBy(*key).agg(*[F.first(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(_feature_name(c)).alias("value")) for c in columns])
    tuples = written(tuples.select(*key, pairs.alias("pairs")), "tuples")
    cells = tuples.select(*key, F.inline("pairs"))
    values = written(cells.select("column", "value").distinct(), "values")

    use_table = spark.createDataFrame(uses, USE_SCHEMA)
    sizes = sorted({min(len(u[1]), GRAM) for u in uses} | {GRAM})
    found = containing_values(values, use_table.select("column", "needle").distinct(), sizes)
    hits = found.join(use_table, ["column", "needle"]).select(
        "column", "value", "rule_idx", "role", F.struct("cond_ord", "val_ord").alias("p"), "raw", "norm_pat"
    )
    if exact:
        hits = hits.unionByName(_exact_hits(values, exact), allowMissingColumns=True)
    proofs = cells.join(written(hits, "hits"), ["column", "value"]).drop("column", "value")
    firsts = [next((c[0] for c in consts if c[at]), None) for at in (7, 8)]
    firsts = sorted({i for i in firsts if i is not None})
    if firsts:
        extra = F.explode(F.array(*map(F.lit, firsts))).alias("rule_idx")
        proofs = proofs.unionByName(tuples.select(*key, extra), allowMissingColumns=True)

    def proved(role: str) -> Column:
        return F.coalesce(F.bool_or(F.col("role") == role), F.lit(False))

    def shown(role: str) -> Column:
        return F.min(F.when(F.col("role") == role, F.struct("p", "raw")))

    weights = [
        F.when(proved(f"kw{n}"), F.lit(cfg.KEYWORD_WEIGHTS[c])).otherwise(F.lit(0.0)) for n, c in enumerate(cfg.KEYWORD_COLUMNS)
    ]
    is_keyword = F.col("role").startswith("kw")
    evidence = proofs.groupBy(*key, "rule_idx").agg(
        proved("art").alias("art"), proved("ven").alias("ven"),
        F.least(F.lit(0.0) + weights[0] + weights[1] + weights[2], F.lit(1.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(is_keyword, F.struct("p", F.col("norm_pat").alias("k"))))).alias("kws"),
        shown("vpat").alias("vpat"), shown("apat").alias("apat"),
    )
    constants = F.broadcast(spark.createDataFrame(consts, CONST_SCHEMA))
    evidence = evidence.join(constants, "rule_idx").select(
        *key, "rule_idx",
        (F.col("art") | F.col("art_always")).alias("art"), (F.col("ven") | F.col("ven_always")).alias("ven"), "score", "kws",
        F.least("vpat", "vpat_always")["raw"].alias("vpat"), F.least("apat", "apat_always")["raw"].alias("apat"),
    )
    tier = F.when(F.col("art"), 1).when(F.col("ven"), 2).when(F.col("score") > 0, 3)
    ranked = evidence.withColumn("tier", tier).where(F.col("tier").isNotNull())
    rank = F.struct(F.col("tier"), F.when(F.col("tier") == 3, -F.col("score")).otherwise(F.lit(0.0)), F.col("rule_idx"))
    win = ranked.groupBy(*key).agg(
        F.min_by(F.struct("rule_idx", "tier", "ven", "score", "kws", "vpat", "apat"), rank).alias("w")
    )
    am = F.coalesce(F.col("w.tier") == 1, F.lit(False))
    vm = F.coalesce((F.col("w.tier") == 2) | ((F.col("w.tier") == 1) & F.col("w.ven")), F.lit(False))
    kwl = F.array_join(F.array_distinct(F.transform(F.col("w.kws"), lambda x: x["k"])), ", ")
    winners = win.withColumn("rule_idx", F.col("w.rule_idx")).join(constants, "rule_idx").select(
        *key, F.col("rule_idx").alias("__w"),
        am.alias("__am"), vm.alias("__vm"), kwl.alias("__kwl"), F.col("w.score").alias("__ks"),
        F.col("rule_id").alias("__rid"), F.col("l1").alias("__l1"), F.col("l2").alias("__l2"), F.col("l3").alias("__l3"),
        F.col("confidence").alias("__base"), F.col("review_below").alias("__rrb"),
        F.when(vm, F.col("w.vpat")).alias("__vp"), F.when(am, F.col("w.apat")).alias("__ap"),
    )
    num = F.greatest(F.lit(0.0), F.least(
        F.col("__base") + F.when(F.col("__am"), F.lit(cfg.ARTICLE_BONUS)).otherwise(F.lit(0.0))
        + F.when(F.col("__vm"), F.lit(cfg.VENDOR_BONUS)).otherwise(F.lit(0.0)) + F.col("__ks") * F.lit(cfg.KEYWORD_FACTOR),
        F.lit(1.0)))
    joined = staged.join(winners.withColumn("__num", num), key, "left")
    out_cols = [f"{expr} AS {name}" for name, expr in _output_fields()]
    original = df.columns
    keep = [f"`{c}`" for c in original if c not in CLASSIFICATION_OUTPUT_COLUMNS]
    return joined.selectExpr(*keep, *out_cols)


def classify(
    df: DataFrame, rules: list[dict[str, Any]] | None = None, form: str = "expression", strict_match_types: bool = False
) -> DataFrame:
    """One entry point for both plans, by name: the narrow "expression" form,
    or the "join" form for rule sets whose expressions outgrow codegen."""
    build = {"expression": classify_payments, "join": classify_payments_join}[form]
    return build(df, cfg.CLASSIFICATION_RULES if rules is None else rules, strict_match_types)
