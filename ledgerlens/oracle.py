"""DuckDB SQL oracles.

Independent formulations of the operators, for the correctness gate: each
oracle is one SQL text over the driver's parquet views (lineitem, orders,
customer, part, supplier, nation).  Only the payments adapter text is shared
with the Spark side; cleaning, status mapping, classification and every mart
are re-stated here in DuckDB's dialect, with the rule engine written as a
join of rows against a VALUES table of rule conditions and a ``row_number``
winner (the Spark side compiles rules into expressions instead).
"""

from __future__ import annotations

from typing import Any

from ledgerlens import config as cfg
from ledgerlens.functions.text import WHITESPACE_CHARS, WHITESPACE_CLASS
from ledgerlens.sources.adapter import RAW_COLUMNS, adapter_sql

WS = WHITESPACE_CLASS
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
QUARTER_RE = r"^(\d{4})\s*[Qq]([1-4])$"
DATE_FORMATS = [
    ("%Y-%m-%d", "iso"),
    ("%Y-%m-%d %H:%M:%S", "iso"),
    ("%Y-%m-%dT%H:%M:%S", "iso"),
    ("%Y-%m-%d %H:%M:%S.%f", "iso"),
    ("%d.%m.%Y", "dot"),
    ("%d.%m.%Y %H:%M:%S", "dot"),
    ("%d/%m/%Y", "slash"),
]
SHAPES = {"iso": (5, "-"), "dot": (3, "."), "slash": (3, "/")}


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + str(text).replace("'", "''") + "'"


def dbl(value: float) -> str:
    return f"CAST({float(value)!r} AS DOUBLE)"


def ustrip(x: str) -> str:
    return f"trim({x}, {q(WHITESPACE_CHARS)})"


def clean_text(x: str) -> str:
    return f"regexp_replace(lower({ustrip(x)}), '{WS}+', ' ', 'g')"


def parse_amount(x: str) -> str:
    t = f"replace(replace(replace({x}, chr(160), ''), ' ', ''), ',', '.')"
    return (
        f"CASE WHEN {t} IN ('', 'nan', 'None', '<NA>') THEN NULL "
        f"WHEN regexp_matches({t}, '{NUMBER_RE}') THEN try_cast({t} AS DOUBLE) END"
    )


def parse_date(x: str) -> str:
    t = ustrip(x)
    parts = [
        f"CASE WHEN substr({t}, {SHAPES[shape][0]}, 1) = '{SHAPES[shape][1]}' THEN try_strptime({t}, '{fmt}') END"
        for fmt, shape in DATE_FORMATS
    ]
    quarter = (
        f"CASE WHEN regexp_matches({t}, '{QUARTER_RE}') THEN make_timestamp("
        f"CAST(regexp_extract({t}, '{QUARTER_RE}', 1) AS BIGINT), "
        f"(CAST(regexp_extract({t}, '{QUARTER_RE}', 2) AS BIGINT) - 1) * 3 + 1, 1, 0, 0, 0) END"
    )
    return f"coalesce({', '.join(parts)}, {quarter})"


def status_values() -> str:
    rows = []
    order = 0
    for status, patterns in cfg.STATUS_RULES.items():
        for pattern in patterns:
            rows.append(f"({q(pattern.lower())}, {q(status)}, {order})")
            order += 1
    return "(VALUES " + ", ".join(rows) + ") AS sr(p, s, o)"


def map_status(x: str) -> str:
    v = f"lower({ustrip(f'coalesce({x}, {q(str())})')})"
    return (
        f"coalesce((SELECT s FROM {status_values()} WHERE p <> '' AND contains({v}, p) "
        f"ORDER BY length(p) DESC, o LIMIT 1), 'other')"
    )


def rule_rows(rules: list[dict[str, Any]] | None = None) -> str:
    """Exploded rule table: one row per (rule, condition, value)."""
    rules = cfg.CLASSIFICATION_RULES if rules is None else rules
    rows = []
    for r_ord, rule in enumerate(rules):
        for c_ord, cond in enumerate(rule["conditions"]):
            for v_ord, value in enumerate(cond["values"]):
                rows.append(
                    "("
                    + ", ".join(
                        [
                            str(r_ord),
                            q(rule["rule_id"]),
                            str(int(rule["priority"])),
                            dbl(rule["confidence"]),
                            dbl(rule.get("review_required_below", cfg.DEFAULT_REVIEW_REQUIRED_BELOW)),
                            q(rule["target"]["l1"]),
                            q(rule["target"]["l2"]),
                            q(rule["target"]["l3"]),
                            str(c_ord),
                            q(cond["column"]),
                            str(v_ord),
                            q(value),
                        ]
                    )
                    + ")"
                )
    return (
        "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(rule_ord, rule_id, priority, confidence, rrb, "
        "l1, l2, l3, cond_ord, col, val_ord, val)"
    )


ARTICLE_SET = "(" + ", ".join(q(c) for c in cfg.ARTICLE_COLUMNS) + ")"
VENDOR_SET = "(" + ", ".join(q(c) for c in cfg.VENDOR_COLUMNS) + ")"
KEYWORD_SET = "(" + ", ".join(q(c) for c in cfg.KEYWORD_COLUMNS) + ")"


def base_ctes(rules: list[dict[str, Any]] | None = None) -> dict[str, str]:
    """Named CTE bodies: raw, seq, clean, feat, conds, ev, kwl, winner,
    classified, fact."""
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in RAW_COLUMNS)
    ctes: dict[str, str] = {}
    ctes["raw"] = adapter_sql()
    ctes["seq"] = f"SELECT *, CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS _row_seq FROM raw"
    text_cols = set(cfg.TEXT_COLUMNS) | set(cfg.ENTITY_COLUMNS)
    select = []
    for c in RAW_COLUMNS:
        if c == "summa":
            select.append(f"{parse_amount(c)} AS summa")
        elif c in ("period", "quarter_period"):
            select.append(f"{parse_date(c)} AS {c}")
        elif c in text_cols:
            select.append(f"{clean_text(c)} AS {c}")
        else:
            select.append(c)
    ctes["clean0"] = (
        f"SELECT {', '.join(select)}, {map_status('registrator_status_name')} AS business_status, _row_seq FROM seq"
    )
    ctes["clean"] = (
        "SELECT *, CAST(year(period) AS INTEGER) AS year, CAST(month(period) AS INTEGER) AS month, "
        "CAST(quarter(period) AS INTEGER) AS quarter, "
        "CASE WHEN period IS NOT NULL THEN CAST(year(period) AS VARCHAR) || '-' || "
        "lpad(CAST(month(period) AS VARCHAR), 2, '0') END AS year_month FROM clean0"
    )
    feat_cols = []
    for c in cfg.FEATURE_COLUMNS:
        src = c if c in RAW_COLUMNS else "NULL"
        feat_cols.append(f"lower({ustrip(f'coalesce(CAST({src} AS VARCHAR), {q(str())})')}) AS f_{c}")
    ctes["feat"] = f"SELECT _row_seq, {', '.join(feat_cols)} FROM clean"
    ctes["conds"] = (
        f"SELECT *, bool_or(val = '*') OVER (PARTITION BY rule_ord, cond_ord) AS cond_star, "
        f"lower({ustrip('val')}) AS nval FROM ({rule_rows(rules)}) r"
    )
    ctes["active"] = (
        "SELECT rule_ord FROM (SELECT rule_ord, cond_ord, bool_and(nval = '*') AS only_star FROM conds "
        "GROUP BY rule_ord, cond_ord) GROUP BY rule_ord HAVING NOT bool_and(only_star)"
    )
    value_of = "CASE c.col " + " ".join(f"WHEN {q(col)} THEN f.f_{col}" for col in cfg.FEATURE_COLUMNS) + " END"
    art_f = f"f.f_{cfg.KEYWORD_COLUMNS[0]}"
    pur_f = f"f.f_{cfg.KEYWORD_COLUMNS[1]}"
    con_f = f"f.f_{cfg.KEYWORD_COLUMNS[2]}"
    ctes["pairs"] = (
        "SELECT f._row_seq, c.rule_ord, c.rule_id, c.priority, c.confidence, c.rrb, c.l1, c.l2, c.l3, "
        "c.cond_ord, c.col, c.val_ord, c.val, c.nval, c.cond_star, "
        f"{value_of} AS v, "
        f"(c.col IN {KEYWORD_SET} AND c.nval <> '' AND c.nval <> '*') AS is_kw, "
        f"contains({art_f}, c.nval) AS in_a, contains({pur_f}, c.nval) AS in_p, contains({con_f}, c.nval) AS in_c "
        "FROM feat f JOIN conds c ON TRUE WHERE c.rule_ord IN (SELECT rule_ord FROM active)"
    )
    ctes["ev"] = (
        "SELECT _row_seq, rule_ord, any_value(rule_id) AS rule_id, any_value(priority) AS priority, "
        "any_value(confidence) AS confidence, any_value(rrb) AS rrb, any_value(l1) AS l1, "
        "any_value(l2) AS l2, any_value(l3) AS l3, "
        f"coalesce(bool_or(col IN {ARTICLE_SET} AND (cond_star OR contains(v, lower(val)))), false) AS art, "
        f"coalesce(bool_or(col IN {VENDOR_SET} AND (cond_star OR contains(v, lower(val)))), false) AS ven, "
        f"least({dbl(1.0)}, {dbl(0.0)} "
        f"+ CASE WHEN bool_or(is_kw AND in_a) THEN {dbl(0.5)} ELSE {dbl(0.0)} END "
        f"+ CASE WHEN bool_or(is_kw AND in_p) THEN {dbl(0.3)} ELSE {dbl(0.0)} END "
        f"+ CASE WHEN bool_or(is_kw AND in_c) THEN {dbl(0.2)} ELSE {dbl(0.0)} END) AS score, "
        f"arg_min(val, (cond_ord, val_ord)) FILTER (WHERE col IN {VENDOR_SET} "
        "AND (nval = '*' OR contains(v, nval))) AS vpat, "
        f"arg_min(val, (cond_ord, val_ord)) FILTER (WHERE col IN {ARTICLE_SET} "
        "AND (nval = '*' OR contains(v, nval))) AS apat "
        "FROM pairs GROUP BY _row_seq, rule_ord"
    )
    ctes["kwfirst"] = (
        "SELECT _row_seq, rule_ord, nval AS kw, min((cond_ord, val_ord)) AS pos FROM pairs "
        "WHERE is_kw AND (in_a OR in_p OR in_c) GROUP BY _row_seq, rule_ord, nval"
    )
    ctes["kwl"] = (
        "SELECT _row_seq, rule_ord, list(kw ORDER BY pos) AS kws FROM kwfirst GROUP BY _row_seq, rule_ord"
    )
    ctes["ranked"] = (
        "SELECT ev.*, coalesce(kwl.kws, []::VARCHAR[]) AS kws, "
        "CASE WHEN art THEN 1 WHEN ven THEN 2 WHEN score > 0 THEN 3 END AS tier "
        "FROM ev LEFT JOIN kwl USING (_row_seq, rule_ord)"
    )
    ctes["winner"] = (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _row_seq ORDER BY tier, "
        "CASE WHEN tier = 3 THEN -score ELSE 0 END, priority, rule_ord) AS rn FROM ranked "
        "WHERE tier IS NOT NULL) WHERE rn = 1"
    )
    am = "(w.tier = 1)"
    vm = "(w.tier = 2 OR (w.tier = 1 AND w.ven))"
    num = (
        f"greatest({dbl(0.0)}, least({dbl(1.0)}, w.confidence + CASE WHEN {am} THEN {dbl(cfg.ARTICLE_BONUS)} "
        f"ELSE {dbl(0.0)} END + CASE WHEN {vm} THEN {dbl(cfg.VENDOR_BONUS)} ELSE {dbl(0.0)} END "
        f"+ w.score * {dbl(cfg.KEYWORD_FACTOR)}))"
    )
    ctes["scored"] = (
        f"SELECT c.*, w.rule_id AS w_rule, w.l1 AS w_l1, w.l2 AS w_l2, w.l3 AS w_l3, w.rrb AS w_rrb, "
        f"w.score AS w_score, w.kws AS w_kws, {am} AS w_am, {vm} AS w_vm, "
        f"CASE WHEN {vm} THEN w.vpat END AS w_vp, CASE WHEN {am} THEN w.apat END AS w_ap, "
        f"{num} AS w_num FROM clean c LEFT JOIN winner w USING (_row_seq)"
    )
    bucket = (
        f"CASE WHEN w_num >= {dbl(cfg.BUCKET_HIGH)} THEN 'high' WHEN w_num >= {dbl(cfg.BUCKET_MEDIUM)} "
        f"THEN 'medium' WHEN w_num > {dbl(0.0)} THEN 'low' ELSE 'unclassified' END"
    )
    evidence = (
        "concat_ws(', ', CASE WHEN w_am THEN 'article' END, CASE WHEN w_vm THEN 'vendor' END, "
        "CASE WHEN w_score > 0 THEN 'keywords=' || printf('%.2f', w_score) END)"
    )
    human = (
        "concat_ws(' ', 'Применено правило ' || w_rule || '.', "
        "CASE WHEN coalesce(w_ap, '') <> '' THEN 'Совпала статья или код с шаблоном ''' || w_ap || '''.' END, "
        "CASE WHEN coalesce(w_vp, '') <> '' THEN 'Совпал поставщик или договор с шаблоном ''' || w_vp || '''.' END, "
        "CASE WHEN len(w_kws) > 0 THEN 'Дополнительно сработали ключевые слова: ' || array_to_string(w_kws, ', ') || '.' END, "
        "'Запись отнесена в категорию ' || w_l1 || ' / ' || w_l2 || ' / ' || w_l3 || '.')"
    )
    ctes["classified"] = (
        "SELECT * EXCLUDE (w_rule, w_l1, w_l2, w_l3, w_rrb, w_score, w_kws, w_am, w_vm, w_vp, w_ap, w_num), "
        f"CASE WHEN w_rule IS NULL THEN 'other_it' ELSE w_l1 END AS l1_category, "
        f"CASE WHEN w_rule IS NULL THEN 'unclassified' ELSE w_l2 END AS l2_category, "
        f"CASE WHEN w_rule IS NULL THEN 'review_required' ELSE w_l3 END AS l3_category, "
        f"CASE WHEN w_rule IS NULL THEN {q(cfg.UNMATCHED_REASON)} ELSE 'Matched rule ''' || w_rule || ''' using ' || "
        f"CASE WHEN {evidence} = '' THEN 'rule fallback' ELSE {evidence} END || '.' END AS classification_reason, "
        f"CASE WHEN w_rule IS NULL THEN {q(cfg.UNMATCHED_REASON_HUMAN)} ELSE {human} END AS classification_reason_human, "
        f"CASE WHEN w_rule IS NULL THEN 'unclassified' ELSE {bucket} END AS classification_confidence, "
        f"CASE WHEN w_rule IS NULL THEN {dbl(0.0)} ELSE round(w_num, 4) END AS classification_confidence_score, "
        "w_rule AS classification_rule_id, w_rule AS matched_rule_id, "
        "CASE WHEN w_rule IS NULL THEN '' ELSE array_to_string(w_kws, ', ') END AS matched_keywords, "
        "w_vp AS matched_vendor_pattern, w_ap AS matched_article_pattern, "
        f"CASE WHEN w_rule IS NULL THEN true ELSE ({bucket} IN ('low', 'unclassified') OR w_num < w_rrb) END "
        "AS review_required FROM scored"
    )
    key_parts = [
        "coalesce(strftime(period, '%Y-%m-%d %H:%M:%S'), '')",
        "coalesce(CAST(CAST(summa AS DOUBLE) AS VARCHAR), '')",
    ] + [f"coalesce({ustrip(c)}, '')" for c in cfg.PAYMENT_ID_COLUMNS[2:]]
    ctes["fact"] = (
        f"SELECT md5(concat_ws('|', {', '.join(key_parts)})) AS payment_id, period AS period_date, "
        "year, month, quarter, coalesce(summa, " + dbl(0.0) + ") AS amount, "
        "coalesce(registrator_status_name, '') AS status_raw, coalesce(business_status, '') AS status_group, "
        "coalesce(bit_stati_oborotov_naimenovanie, '') AS article_name, "
        "coalesce(bit_stati_oborotov_kodifikator, '') AS article_code, "
        "coalesce(kontragenti_naimenovanie, '') AS vendor_name, "
        "coalesce(dogovori_kontragentov_naimenovanie, '') AS contract_name, "
        "coalesce(proekti_naimenovanie, '') AS project_name, "
        "coalesce(podrazdeleniya_naimenovanie, '') AS department_name, "
        "coalesce(organizacii_naimenovanie, '') AS organization_name, "
        "coalesce(l1_category, 'other_it') AS l1_category, coalesce(l2_category, 'unclassified') AS l2_category, "
        "coalesce(l3_category, 'review_required') AS l3_category, "
        "coalesce(classification_confidence, 'unclassified') AS classification_confidence, "
        "coalesce(matched_rule_id, '') AS matched_rule_id, coalesce(matched_keywords, '') AS matched_keywords, "
        "coalesce(matched_vendor_pattern, '') AS matched_vendor_pattern, "
        "coalesce(matched_article_pattern, '') AS matched_article_pattern, "
        "coalesce(classification_reason_human, '') AS classification_reason_human, _row_seq FROM classified"
    )
    return ctes


def with_ctes(final_select: str, rules: list[dict[str, Any]] | None = None) -> str:
    ctes = base_ctes(rules)
    body = ",\n".join(f"{name} AS (\n{text}\n)" for name, text in ctes.items())
    return f"WITH {body}\n{final_select}"


def exact_sum(col: str) -> str:
    return f"coalesce(CAST(sum(CAST({col} AS DECIMAL(28,6))) AS DOUBLE), {dbl(0.0)})"


AMOUNT_AND_COUNT = f"{exact_sum('amount')} AS total_amount, count(DISTINCT payment_id) AS payments_count"


def fmt_k(x: str) -> str:
    """Thousands format: '1 234,57 тыс. руб.'"""
    return (
        f"(replace(replace(replace(format('{{:,.2f}}', ({x}) / {dbl(1000.0)}), ',', '#'), '.', ','), '#', ' ') "
        "|| ' тыс. руб.')"
    )


def pct(x: str) -> str:
    return f"(format('{{:.1f}}', ({x}) * {dbl(100.0)}) || '%')"


def slug(x: str) -> str:
    """Slug in DuckDB for ASCII / Cyrillic labels."""
    from ledgerlens.config import CYRILLIC_TO_LATIN

    expr = f"lower({ustrip(f'coalesce({x}, {q(str())})')})"
    for src, dst in CYRILLIC_TO_LATIN.items():
        expr = f"replace({expr}, {q(src)}, {q(dst)})"
    s = f"trim(regexp_replace({expr}, '[^0-9a-zA-Z]+', '_', 'g'), '_')"
    return f"(CASE WHEN {s} = '' THEN 'unknown' ELSE {s} END)"


def ser_double(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def ser_ts(x: str) -> str:
    return f"coalesce(strftime({x}, '%Y-%m-%dT%H:%M:%S'), '')"


def ser_str(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


# The audit and search fields as the inventory states them, apart from the operators' own lists.
AUDIT_GROUPS = [
    (["summa", "summa_regl", "summa_upr", "summa_vzaimorascheti"], "amount_numeric_parse", "Парсинг числовой суммы"),
    (
        ["period", "quarter_period", "bit_zayavka_na_rashodovanie_sredstv_data", "bit_platezhnaya_poziciya_data"],
        "date_normalization", "Нормализация даты",
    ),
    (
        ["bit_stati_oborotov_naimenovanie", "naznachenie_platezha", "kontragenti_naimenovanie",
         "dogovori_kontragentov_naimenovanie"],
        "text_cleanup", "Нормализация текстового поля",
    ),
    (
        ["organizacii_naimenovanie", "podrazdeleniya_naimenovanie", "proekti_naimenovanie", "kontragenti_naimenovanie"],
        "entity_normalization", "Нормализация справочника сущностей",
    ),
]
AUDIT_STATUS = ("status_mapping", "Маппинг статуса в бизнес-статус")
AUDIT_DERIVED = ("date_derived_fields", "Расчет производных полей отчетного периода")
DERIVED = ["year", "month", "quarter", "year_month"]
PIPELINE = [
    "business_status", "year", "month", "quarter", "year_month", "l1_category", "l2_category", "l3_category",
    "classification_confidence", "classification_confidence_score", "matched_rule_id", "matched_keywords",
    "matched_vendor_pattern", "matched_article_pattern", "classification_reason_human",
]
SEARCHED = [
    "vendor_label", "organization_label", "expense_subject", "article_name", "contract_name", "project_name",
    "department_name", "l1_category_label", "l2_category_label", "l3_category_label", "classification_reason_human",
]
