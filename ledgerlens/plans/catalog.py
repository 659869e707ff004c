"""Registered queries: one Spark builder and (when SQL can express it) one
DuckDB oracle per operator of the inventory.

Every query reads the driver's tables through the payments adapter and runs
the whole pipeline up to the operator it exercises, over all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import config as cfg
from ledgerlens import oracle as O
from ledgerlens.operators import classify as D
from ledgerlens.operators import clean as C
from ledgerlens.operators import marts as E
from ledgerlens.plans import stages
from ledgerlens.session import shared_dir, written
from ledgerlens.sources import sinks
from ledgerlens.sources.adapter import ADAPTER_YEARS, RAW_COLUMNS
from ledgerlens.sources.ingest import ROW_SEQ, row_at, with_row_seq
from ledgerlens.functions.text import tokenize, ustrip

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# Years used with the adapter data (1995-2001) wherever the reference
# hard-codes its two reporting years.
YEARS = ADAPTER_YEARS


def register(name: str, oracle_select: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle_select is not None:
            ORACLES[name] = O.with_ctes(oracle_select)
        return fn

    return wrap


# ---------------------------------------------------------------- 2.1 / 2.2


@register(
    "dataset_profile",
    "SELECT column_name, 'string' AS dtype, CAST((SELECT count(*) FROM raw) AS BIGINT) AS row_count, "
    "CAST(null_count AS BIGINT) AS null_count FROM (UNPIVOT (SELECT "
    + ", ".join(f"count(*) - count({c}) AS {c}" for c in RAW_COLUMNS)
    + " FROM raw) ON COLUMNS(*) INTO NAME column_name VALUE null_count)",
)
def q_dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.sources.profile import dataset_profile

    return dataset_profile(stages.ingested(spark, sf_dir).drop(ROW_SEQ))


@register(
    "classification_input_projection",
    "SELECT _row_seq, "
    + ", ".join(
        f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" if c in RAW_COLUMNS else f"'' AS {c}"
        for c in cfg.FEATURE_COLUMNS
    )
    + " FROM clean",
)
def q_classification_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.classification_input(stages.cleaned(spark, sf_dir))


# ---------------------------------------------------------------- 2.3 cleaning


@register(
    "parse_amount",
    f"SELECT _row_seq, summa AS summa_raw, {O.parse_amount('summa')} AS summa FROM seq",
)
def q_parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stages.ingested(spark, sf_dir).select(ROW_SEQ, F.col("summa").alias("summa_raw"), "summa")
    return C.normalize_amount_columns(raw)


@register(
    "parse_dates",
    "SELECT _row_seq, period, quarter_period, year, month, quarter, year_month FROM clean",
)
def q_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stages.ingested(spark, sf_dir).select(ROW_SEQ, "period", "quarter_period")
    return C.normalize_date_columns(raw)


@register(
    "derive_reporting_period",
    "SELECT year, month, quarter, year_month, count(*) AS n FROM clean GROUP BY ALL",
)
def q_derive_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.normalize_date_columns(stages.ingested(spark, sf_dir).select("period", "quarter_period"))
    return df.groupBy("year", "month", "quarter", "year_month").agg(F.count(F.lit(1)).alias("n"))


@register(
    "map_status",
    "SELECT _row_seq, registrator_status_name, business_status FROM clean",
)
def q_map_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stages.ingested(spark, sf_dir).select(ROW_SEQ, "registrator_status_name")
    return C.normalize_statuses(raw)


@register(
    "clean_text",
    "SELECT _row_seq, " + ", ".join(cfg.TEXT_COLUMNS) + " FROM clean",
)
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stages.ingested(spark, sf_dir).select(ROW_SEQ, *cfg.TEXT_COLUMNS)
    return C.normalize_text_columns(raw)


@register(
    "clean_entities",
    "SELECT _row_seq, " + ", ".join(cfg.ENTITY_COLUMNS) + " FROM clean",
)
def q_clean_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stages.ingested(spark, sf_dir).select(ROW_SEQ, *cfg.ENTITY_COLUMNS)
    return C.normalize_entity_columns(raw)


@register(
    "tokenize_text",
    "SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_split_to_array("
    "lower(coalesce(bit_stati_oborotov_naimenovanie, '') || ' ' || coalesce(naznachenie_platezha, '')), "
    "'[^0-9a-zA-Zа-яА-Я]+')) AS token FROM clean) WHERE token <> '' GROUP BY token",
)
def q_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stages.cleaned(spark, sf_dir)
    text = F.concat(
        F.coalesce(F.col("bit_stati_oborotov_naimenovanie"), F.lit("")),
        F.lit(" "),
        F.coalesce(F.col("naznachenie_platezha"), F.lit("")),
    )
    tokens = df.select(F.explode(tokenize(text)).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register(
    "clean_payments",
    "SELECT * FROM clean",
)
def q_clean_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.cleaned(spark, sf_dir)


REQUIRED_YEARS_CHECK = tuple(YEARS) + tuple(cfg.DEFAULT_REPORTING_YEARS)


@register(
    "require_years",
    "SELECT year FROM (VALUES "
    + ", ".join(f"({int(y)})" for y in REQUIRED_YEARS_CHECK)
    + ") AS r(year) WHERE year NOT IN (SELECT year FROM clean WHERE year IS NOT NULL)",
)
def q_require_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_reporting_years(stages.cleaned(spark, sf_dir), REQUIRED_YEARS_CHECK)


# ---------------------------------------------------------------- 2.4 classification

CLASS_COLS = ", ".join(D.CLASSIFICATION_OUTPUT_COLUMNS)


@register("classify_payments", f"SELECT _row_seq, {CLASS_COLS} FROM classified")
def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.classified(spark, sf_dir).select(ROW_SEQ, *D.CLASSIFICATION_OUTPUT_COLUMNS)


@register(
    "select_rule",
    "SELECT _row_seq, matched_rule_id, l1_category, l2_category, l3_category FROM classified",
)
def q_select_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.classified(spark, sf_dir).select(ROW_SEQ, "matched_rule_id", "l1_category", "l2_category", "l3_category")


@register(
    "confidence_score",
    "SELECT _row_seq, classification_confidence_score, classification_confidence FROM classified",
)
def q_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.classified(spark, sf_dir).select(ROW_SEQ, "classification_confidence_score", "classification_confidence")


@register(
    "confidence_bucket",
    "SELECT classification_confidence, CAST(count(*) AS BIGINT) AS n FROM classified GROUP BY ALL",
)
def q_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.classified(spark, sf_dir).groupBy("classification_confidence").agg(F.count(F.lit(1)).alias("n"))


@register(
    "classification_reason",
    "SELECT _row_seq, classification_reason, classification_reason_human FROM classified",
)
def q_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.classified(spark, sf_dir).select(ROW_SEQ, "classification_reason", "classification_reason_human")


@register("review_required", "SELECT _row_seq, review_required FROM classified")
def q_review_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.classified(spark, sf_dir).select(ROW_SEQ, "review_required")


@register(
    "matched_patterns",
    "SELECT _row_seq, matched_vendor_pattern, matched_article_pattern FROM classified",
)
def q_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.classified(spark, sf_dir).select(ROW_SEQ, "matched_vendor_pattern", "matched_article_pattern")


@register(
    "unmatched_default",
    f"SELECT _row_seq, {CLASS_COLS} FROM classified WHERE matched_rule_id IS NULL",
)
def q_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        stages.classified(spark, sf_dir)
        .where(F.col("matched_rule_id").isNull())
        .select(ROW_SEQ, *D.CLASSIFICATION_OUTPUT_COLUMNS)
    )


EVIDENCE_SQL = (
    "SELECT ev._row_seq, ev.rule_id, ev.priority, ev.art AS article_match, ev.ven AS vendor_match, "
    "coalesce(array_to_string(kwl.kws, ', '), '') AS matched_keywords, ev.score AS keyword_score "
    "FROM ev LEFT JOIN kwl USING (_row_seq, rule_ord) WHERE ev.art OR ev.ven OR ev.score > 0"
)


@register("rule_evidence", EVIDENCE_SQL)
def q_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rule_evidence(stages.cleaned(spark, sf_dir))


@register("match_article", f"SELECT _row_seq, rule_id FROM ({EVIDENCE_SQL}) WHERE article_match")
def q_match_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rule_evidence(stages.cleaned(spark, sf_dir)).where("article_match").select(ROW_SEQ, "rule_id")


@register("match_vendor", f"SELECT _row_seq, rule_id FROM ({EVIDENCE_SQL}) WHERE vendor_match")
def q_match_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rule_evidence(stages.cleaned(spark, sf_dir)).where("vendor_match").select(ROW_SEQ, "rule_id")


@register(
    "match_keywords",
    f"SELECT _row_seq, rule_id, matched_keywords, keyword_score FROM ({EVIDENCE_SQL}) WHERE keyword_score > 0",
)
def q_match_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        D.rule_evidence(stages.cleaned(spark, sf_dir))
        .where(F.col("keyword_score") > 0)
        .select(ROW_SEQ, "rule_id", "matched_keywords", "keyword_score")
    )


REVIEW_SQL = (
    "SELECT coalesce(bit_stati_oborotov_naimenovanie, '') AS raw_article, "
    "coalesce(naznachenie_platezha, '') AS raw_description, coalesce(kontragenti_naimenovanie, '') AS raw_vendor, "
    "l1_category AS suggested_l1, l2_category AS suggested_l2, l3_category AS suggested_l3, "
    "classification_confidence AS confidence, classification_reason AS reason, _row_seq "
    "FROM classified WHERE classification_confidence IN ('low', 'unclassified')"
)


@register("review_queue", REVIEW_SQL)
def q_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.build_review_queue(stages.classified(spark, sf_dir))


# ---------------------------------------------------------------- 2.5 marts

FACT_COLS = ", ".join(cfg.FACT_COLUMNS)


@register("fact_projection", f"SELECT {FACT_COLS}, _row_seq FROM fact")
def q_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.fact(spark, sf_dir)


@register("payment_id", "SELECT _row_seq, payment_id FROM fact")
def q_payment_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.fact(spark, sf_dir).select(ROW_SEQ, "payment_id")


@register("fact_amount", "SELECT _row_seq, amount FROM fact")
def q_fact_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.fact(spark, sf_dir).select(ROW_SEQ, "amount")


@register("period_date", "SELECT _row_seq, period_date, year, month, quarter FROM fact")
def q_period_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.fact(spark, sf_dir).select(ROW_SEQ, "period_date", "year", "month", "quarter")


def _dim_sql(cols: list[str], key: str) -> str:
    c = ", ".join(cols)
    return (
        f"SELECT CAST(row_number() OVER (ORDER BY first_seen) AS BIGINT) AS {key}, {c} "
        f"FROM (SELECT {c}, min(_row_seq) AS first_seen FROM fact GROUP BY {c})"
    )


@register("dim_vendors", _dim_sql(["vendor_name"], "vendor_id"))
def q_dim_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_dim_vendors(stages.fact(spark, sf_dir))


@register("dim_articles", _dim_sql(["article_code", "article_name"], "article_id"))
def q_dim_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_dim_articles(stages.fact(spark, sf_dir))


@register("dim_orgs", _dim_sql(["organization_name"], "organization_id"))
def q_dim_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_dim_orgs(stages.fact(spark, sf_dir))


@register("dim_projects", _dim_sql(["project_name"], "project_id"))
def q_dim_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_dim_projects(stages.fact(spark, sf_dir))


def _agg_sql(dims: list[str], where: str = "") -> str:
    d = ", ".join(dims)
    return f"SELECT {d}, {O.AMOUNT_AND_COUNT} FROM fact {where} GROUP BY {d}"


@register(
    "agg_kpi_year_month",
    f"SELECT year, month, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS year_month, "
    f"{O.AMOUNT_AND_COUNT} FROM fact GROUP BY year, month",
)
def q_agg_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_agg_kpi_year_month(stages.unclassified_fact(spark, sf_dir))


@register("agg_status", _agg_sql(["status_group"]))
def q_agg_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_agg_status(stages.unclassified_fact(spark, sf_dir))


@register("agg_categories", _agg_sql(["l1_category", "l2_category", "l3_category"]))
def q_agg_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_agg_categories(stages.plain_fact(spark, sf_dir))


@register("agg_vendors", _agg_sql(["vendor_name"]))
def q_agg_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_agg_vendors(stages.unclassified_fact(spark, sf_dir))


@register("agg_orgs", _agg_sql(["organization_name"]))
def q_agg_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_agg_orgs(stages.unclassified_fact(spark, sf_dir))


@register("agg_department", _agg_sql(["department_name"]))
def q_agg_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_agg_department(stages.unclassified_fact(spark, sf_dir))


@register(
    "agg_year_compare",
    _agg_sql(["year"], f"WHERE year IN ({', '.join(str(y) for y in YEARS)})"),
)
def q_agg_year_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_agg_year_compare(stages.unclassified_fact(spark, sf_dir), YEARS)


_RECONCILE_SETS = {
    "agg_kpi_year_month": "year, month",
    "agg_status": "status_group",
    "agg_categories": "l1_category, l2_category, l3_category",
    "agg_vendors": "vendor_name",
    "agg_orgs": "organization_name",
    "agg_department": "department_name",
}


@register(
    "reconcile_totals",
    "SELECT aggregate, coalesce(CAST(total AS DOUBLE), "
    + O.dbl(0.0)
    + ") AS total_amount, coalesce(CAST(ft AS DOUBLE), "
    + O.dbl(0.0)
    + ") AS fact_total, coalesce(total, 0) = coalesce(ft, 0) AS reconciled FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS aggregate, sum(s) AS total FROM (SELECT sum(CAST(amount AS DECIMAL(28,6))) AS s "
        f"FROM fact GROUP BY {dims})"
        for name, dims in _RECONCILE_SETS.items()
    )
    + ") JOIN (SELECT sum(CAST(amount AS DECIMAL(28,6))) AS ft FROM fact) ON TRUE",
)
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reconcile_totals(stages.plain_fact(spark, sf_dir))


# ---------------------------------------------------------------- 2.6 insights

from ledgerlens.operators import insights as INS  # noqa: E402
from ledgerlens.operators import quality as QA  # noqa: E402

INSIGHT_OUT = ["title", "metric", "explanation", "severity", "filters_json", "value", "share"]
EMPTY_T = O.q(cfg.EMPTY_INSIGHT_TEXT)


def _insight_frame(df: DataFrame) -> DataFrame:
    return df.select(
        "title", "metric", "explanation", "severity",
        F.to_json("supporting_filters").alias("filters_json"), "value", "share",
    )


def _insight_sql(title: str, has: str, metric: str, expl: str, sev: str, filters: str, value: str, share: str,
                 source: str, empty_metric: str = "'0'", empty_text: str = EMPTY_T, empty_filters: str = "'{}'") -> str:
    return (
        f"SELECT {O.q(title)} AS title, CASE WHEN {has} THEN {metric} ELSE {empty_metric} END AS metric, "
        f"CASE WHEN {has} THEN {expl} ELSE {empty_text} END AS explanation, "
        f"CASE WHEN {has} THEN {sev} ELSE 'info' END AS severity, "
        f"CASE WHEN {has} THEN to_json({filters}) ELSE {empty_filters} END AS filters_json, "
        f"CASE WHEN {has} THEN CAST({value} AS DOUBLE) END AS value, "
        f"CASE WHEN {has} THEN CAST({share} AS DOUBLE) END AS share FROM ({source})"
    )


def _top_sql(key: str) -> str:
    return (
        f"SELECT first(k ORDER BY t DESC, k) AS k, first(t ORDER BY t DESC, k) AS t, "
        f"CAST(sum(CAST(t AS DECIMAL(28,6))) AS DOUBLE) AS grand, count(*) AS groups FROM "
        f"(SELECT {key} AS k, {O.exact_sum('amount')} AS t FROM fact WHERE {key} IS NOT NULL GROUP BY 1)"
    )


F1_SQL = _insight_sql(
    cfg.TITLE_TOP_CATEGORY, "groups > 0",
    f"k || ': ' || {O.fmt_k('t')} || ' (' || {O.pct('sh')} || ')'",
    f"'Наибольшая доля затрат приходится на категорию «' || k || '». Ее удельный вес составляет ' || {O.pct('sh')} "
    "|| ' от общего объема расходов.'",
    f"CASE WHEN sh >= {O.dbl(cfg.TOP_CATEGORY_WARNING_SHARE)} THEN 'warning' ELSE 'info' END",
    "MAP {'l1_category': [k]}", "t", "sh",
    f"SELECT *, CASE WHEN grand <> 0 THEN t / grand ELSE {O.dbl(0.0)} END AS sh FROM ({_top_sql('l1_category')})",
)

Y1, Y2 = YEARS
F2_SQL = _insight_sql(
    cfg.TITLE_YOY, "has_a AND has_b",
    f"k || ': ' || {O.fmt_k('d')} || ' (' || CASE WHEN isinf(g) THEN {O.q(cfg.NEW_CATEGORY_TEXT)} ELSE {O.pct('g')} END || ')'",
    f"'По сравнению с {Y1} годом максимальный прирост в {Y2} году наблюдается в категории «' || k || "
    f"'». Абсолютное изменение составляет ' || {O.fmt_k('d')} || '.'",
    f"CASE WHEN d > 0 AND (isinf(g) OR g >= {O.dbl(cfg.YOY_CRITICAL_GROWTH)}) THEN 'critical' ELSE 'warning' END",
    f"MAP {{'l1_category': [k], 'year': ['{Y1}', '{Y2}']}}", "d", "g",
    "SELECT first(l1_category ORDER BY delta DESC, growth DESC, l1_category) AS k, "
    "first(delta ORDER BY delta DESC, growth DESC, l1_category) AS d, "
    "first(growth ORDER BY delta DESC, growth DESC, l1_category) AS g, "
    "coalesce(bool_or(has_a), false) AS has_a, coalesce(bool_or(has_b), false) AS has_b FROM ("
    f"SELECT l1_category, b - a AS delta, CASE WHEN a > 0 THEN b / a - {O.dbl(1.0)} WHEN b > 0 THEN "
    f"CAST('inf' AS DOUBLE) ELSE {O.dbl(0.0)} END AS growth, has_a, has_b FROM ("
    f"SELECT l1_category, CAST(coalesce(sum(CASE WHEN year = {Y1} THEN CAST(amount AS DECIMAL(28,6)) END), 0) AS DOUBLE) AS a, "
    f"CAST(coalesce(sum(CASE WHEN year = {Y2} THEN CAST(amount AS DECIMAL(28,6)) END), 0) AS DOUBLE) AS b, "
    f"bool_or(year = {Y1}) AS has_a, bool_or(year = {Y2}) AS has_b "
    f"FROM fact WHERE year IN ({Y1}, {Y2}) AND l1_category IS NOT NULL GROUP BY l1_category))",
)

UNPAID_IN = "('approved_not_paid', 'in_approval')"
F3_SQL = _insight_sql(
    cfg.TITLE_BOTTLENECK, "groups > 0",
    f"k || ': ' || {O.fmt_k('t')}",
    f"'Наибольший объем зависших расходов находится в статусе «' || k || '». В этом статусе сосредоточено ' "
    f"|| CAST(c AS VARCHAR) || ' операций на сумму ' || {O.fmt_k('t')} || '.'",
    "CASE WHEN k = 'approved_not_paid' THEN 'critical' ELSE 'warning' END",
    "MAP {'status_group': [k]}", "t", "NULL",
    "SELECT first(k ORDER BY t DESC, k) AS k, first(t ORDER BY t DESC, k) AS t, first(c ORDER BY t DESC, k) AS c, "
    f"count(*) AS groups FROM (SELECT status_group AS k, {O.exact_sum('amount')} AS t, count(DISTINCT payment_id) AS c "
    f"FROM fact WHERE status_group IN {UNPAID_IN} GROUP BY 1)",
    empty_metric=O.q(cfg.ZERO_THOUSANDS), empty_text=O.q(cfg.BOTTLENECK_EMPTY_TEXT),
    empty_filters="to_json(MAP {'status_group': ['approved_not_paid', 'in_approval']})",
)

F4_SQL = _insight_sql(
    cfg.TITLE_VENDOR, "groups > 0",
    f"k || ': ' || {O.pct('sh')}",
    f"'На одного поставщика приходится ' || {O.pct('sh')} || ' всех расходов. Крупнейший контрагент «' || k || "
    f"'» формирует затраты на сумму ' || {O.fmt_k('t')} || '.'",
    f"CASE WHEN sh >= {O.dbl(cfg.VENDOR_CRITICAL_SHARE)} THEN 'critical' WHEN sh >= {O.dbl(cfg.VENDOR_WARNING_SHARE)} "
    "THEN 'warning' ELSE 'info' END",
    "MAP {'vendor_name': [k]}", "t", "sh",
    f"SELECT *, CASE WHEN grand <> 0 THEN t / grand ELSE {O.dbl(0.0)} END AS sh FROM ({_top_sql('vendor_name')})",
)

F5_SQL = _insight_sql(
    cfg.TITLE_UNPAID, "n > 0",
    O.fmt_k("a"),
    f"'Крупнейшая зависшая сумма составляет ' || {O.fmt_k('a')} || '. Операция относится к категории «' || l1 || "
    "' / ' || l2 || '» и контрагенту «' || v || '».'",
    f"CASE WHEN a >= med * {O.dbl(cfg.UNPAID_CRITICAL_MEDIAN_FACTOR)} THEN 'critical' ELSE 'warning' END",
    "MAP {'payment_id': [pid], 'status_group': [s], 'vendor_name': [v]}", "a", "med",
    "SELECT first(amount ORDER BY amount DESC, payment_id) AS a, first(l1_category ORDER BY amount DESC, payment_id) AS l1, "
    "first(l2_category ORDER BY amount DESC, payment_id) AS l2, first(vendor_name ORDER BY amount DESC, payment_id) AS v, "
    "first(payment_id ORDER BY amount DESC, payment_id) AS pid, first(status_group ORDER BY amount DESC, payment_id) AS s, "
    f"quantile_cont(amount, 0.5) AS med, count(*) AS n FROM fact WHERE status_group IN {UNPAID_IN}",
    empty_metric=O.q(cfg.ZERO_THOUSANDS), empty_text=O.q(cfg.UNPAID_EMPTY_TEXT),
    empty_filters="to_json(MAP {'status_group': ['approved_not_paid', 'in_approval']})",
)

F6_SQL = _insight_sql(
    cfg.TITLE_UNCATEGORIZED, "true",
    f"CAST(c AS VARCHAR) || ' записей (' || {O.pct('sh')} || ')'",
    f"'Доля расходов, требующих ручной проверки или уточнения категории, составляет ' || {O.pct('sh')} || "
    "'. Высокое значение этого показателя снижает качество управленческой отчетности.'",
    f"CASE WHEN sh >= {O.dbl(cfg.UNCATEGORIZED_CRITICAL_SHARE)} THEN 'critical' WHEN sh >= "
    f"{O.dbl(cfg.UNCATEGORIZED_WARNING_SHARE)} THEN 'warning' ELSE 'info' END",
    "MAP {'review_required': ['true']}", "c", "sh",
    f"SELECT c, CASE WHEN n > 0 THEN c / n ELSE {O.dbl(0.0)} END AS sh FROM (SELECT count(*) AS n, "
    "count(*) FILTER (WHERE coalesce(l1_category = 'other_it' OR classification_confidence IN ('low', 'unclassified'), false)) AS c FROM fact)",
)

ANOMALY_ROWS_SQL = (
    "SELECT f.* FROM fact f JOIN (SELECT l1_category, q3 + "
    f"{O.dbl(cfg.ANOMALY_IQR_FACTOR)} * (q3 - q1) AS upper_bound FROM (SELECT l1_category, "
    "quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3, count(amount) AS n FROM fact "
    f"WHERE l1_category IS NOT NULL GROUP BY 1) WHERE n >= {cfg.ANOMALY_MIN_ROWS}) b USING (l1_category) "
    "WHERE f.amount > b.upper_bound"
)
F7_SQL = _insight_sql(
    cfg.TITLE_ANOMALY, "cnt > 0",
    "CAST(cnt AS VARCHAR) || ' кандидатов'",
    "'Обнаружены операции с нетипично высокой суммой относительно своей категории. Максимальное отклонение "
    f"наблюдается по записи на ' || {O.fmt_k('a')} || ' в категории «' || l1 || '».'",
    "'warning'",
    "MAP {'l1_category': [l1], 'payment_id': [pid]}", "cnt", "a",
    "SELECT count(*) AS cnt, first(amount ORDER BY amount DESC, payment_id) AS a, "
    "first(l1_category ORDER BY amount DESC, payment_id) AS l1, first(payment_id ORDER BY amount DESC, payment_id) AS pid, "
    f"(SELECT count(*) FROM fact) AS fact_rows FROM ({ANOMALY_ROWS_SQL})",
    empty_text=f"CASE WHEN fact_rows > 0 THEN {O.q(cfg.ANOMALY_EMPTY_TEXT)} ELSE {EMPTY_T} END",
)


@register("top_spend_category", F1_SQL)
def q_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insight_frame(INS.top_spend_category(stages.plain_fact(spark, sf_dir)))


@register("yoy_growth", F2_SQL)
def q_f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insight_frame(INS.yoy_growth(stages.plain_fact(spark, sf_dir), YEARS))


@register("status_bottleneck", F3_SQL)
def q_f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insight_frame(INS.status_bottleneck(stages.plain_fact(spark, sf_dir)))


@register("vendor_concentration", F4_SQL)
def q_f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insight_frame(INS.vendor_concentration(stages.plain_fact(spark, sf_dir)))


@register("large_unpaid_item", F5_SQL)
def q_f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insight_frame(INS.large_unpaid_item(stages.plain_fact(spark, sf_dir)))


@register("uncategorized_share", F6_SQL)
def q_f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insight_frame(INS.uncategorized_share(stages.plain_fact(spark, sf_dir)))


@register("anomaly_candidates", F7_SQL)
def q_f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insight_frame(INS.anomaly_candidates(stages.plain_fact(spark, sf_dir)))


@register(
    "anomaly_rows",
    "SELECT _row_seq, payment_id, l1_category, amount FROM (" + ANOMALY_ROWS_SQL + ")",
)
def q_anomaly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return INS.anomaly_rows(_anomaly_input(spark, sf_dir)).select(ROW_SEQ, "payment_id", "l1_category", "amount")


def _anomaly_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(stages.fact(spark, sf_dir).select(ROW_SEQ, "payment_id", "l1_category", "amount"), "anomaly_input")


# a lower factor than the reference's, under which these tables do have outliers
SENSITIVE_FACTOR = 0.25


@register(
    "anomaly_rows_sensitive",
    "SELECT _row_seq, payment_id, l1_category, amount FROM ("
    + ANOMALY_ROWS_SQL.replace(O.dbl(cfg.ANOMALY_IQR_FACTOR), O.dbl(SENSITIVE_FACTOR)) + ")",
)
def q_anomaly_rows_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = INS.anomaly_rows(_anomaly_input(spark, sf_dir), SENSITIVE_FACTOR)
    return rows.select(ROW_SEQ, "payment_id", "l1_category", "amount")


RANK_SQL = (
    "SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 99 END "
    "AS severity_rank FROM (" + " UNION ALL ".join(f"({s})" for s in [F1_SQL, F2_SQL, F3_SQL, F4_SQL, F5_SQL, F6_SQL, F7_SQL])
    + f") ORDER BY severity_rank, title LIMIT {cfg.INSIGHT_LIMIT}"
)


@register("rank_insights", RANK_SQL)
def q_f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = INS.rank_insights(stages.plain_fact(spark, sf_dir), YEARS)
    return ranked.select(
        "title", "metric", "explanation", "severity", F.to_json("supporting_filters").alias("filters_json"),
        "value", "share", "severity_rank",
    )


@register(
    "format_amount_thousands",
    f"SELECT l1_category, total_amount, {O.fmt_k('total_amount')} AS total_text FROM "
    f"(SELECT l1_category, {O.exact_sum('amount')} AS total_amount FROM fact GROUP BY 1)",
)
def q_f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.functions.formatting import amount_thousands

    agg = stages.plain_fact(spark, sf_dir).groupBy("l1_category").agg(E.exact_sum(F.col("amount")).alias("total_amount"))
    return agg.withColumn("total_text", amount_thousands(F.col("total_amount")))


# ---------------------------------------------------------------- 2.7 quality

QA_YEARS = YEARS


def _qa_sql() -> str:
    RAW_ST = O.ustrip("coalesce(status_raw, '')")
    fields = cfg.QA_REQUIRED_FACT_FIELDS
    null_shares = ", ".join(f"avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END) AS s_{f}" for f in fields)
    cat = " + ".join(f"CASE WHEN s_{f} > {O.dbl(cfg.QA_MAX_NULL_SHARE)} THEN 1 ELSE 0 END" for f in fields)
    allowed = ", ".join(str(y) for y in QA_YEARS)
    return (
        "SELECT check_id, passed, severity, CAST(metric AS DOUBLE) AS metric, CAST(threshold AS DOUBLE) AS threshold FROM ("
        f"SELECT 'required_fields_nulls' AS check_id, ({cat}) = 0 AS passed, CASE WHEN ({cat}) = 0 THEN 'info' ELSE "
        f"'critical' END AS severity, ({cat}) AS metric, {O.dbl(cfg.QA_MAX_NULL_SHARE)} AS threshold FROM "
        f"(SELECT {null_shares} FROM fact) "
        "UNION ALL "
        f"SELECT 'amounts_parsed', rate >= {O.dbl(cfg.QA_MIN_PARSE_RATE)}, CASE WHEN rate < {O.dbl(cfg.QA_MIN_PARSE_RATE)} "
        f"THEN 'critical' ELSE 'info' END, round(rate, 4), {O.dbl(cfg.QA_MIN_PARSE_RATE)} FROM "
        "(SELECT count(amount) / count(*) AS rate FROM fact) "
        "UNION ALL "
        f"SELECT 'year_bounds', n = 0, CASE WHEN n = 0 THEN 'info' ELSE 'warning' END, n, {O.dbl(0.0)} FROM "
        f"(SELECT count(DISTINCT year) FILTER (WHERE year IS NOT NULL AND year NOT IN ({allowed})) AS n FROM fact) "
        "UNION ALL "
        f"SELECT 'status_mapping_coverage', cov >= {O.dbl(cfg.QA_MIN_STATUS_COVERAGE)}, CASE WHEN cov < "
        f"{O.dbl(cfg.QA_MIN_STATUS_COVERAGE)} THEN 'warning' ELSE 'info' END, round(cov, 4), "
        f"{O.dbl(cfg.QA_MIN_STATUS_COVERAGE)} FROM (SELECT CASE WHEN e > 0 THEN c / e ELSE {O.dbl(1.0)} END AS cov FROM "
        f"(SELECT count(*) FILTER (WHERE {RAW_ST} <> '') AS e, count(*) FILTER (WHERE "
        f"{RAW_ST} <> '' AND coalesce(status_group, '') NOT IN ('', 'other')) AS c FROM fact)) "
        "UNION ALL "
        f"SELECT 'classification_coverage', cov >= {O.dbl(cfg.QA_MIN_CLASSIFICATION_COVERAGE)}, CASE WHEN cov < "
        f"{O.dbl(cfg.QA_MIN_CLASSIFICATION_COVERAGE)} THEN 'warning' ELSE 'info' END, round(cov, 4), "
        f"{O.dbl(cfg.QA_MIN_CLASSIFICATION_COVERAGE)} FROM (SELECT CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE "
        f"coalesce(l1_category, 'other_it') NOT IN ('', 'other_it')) / count(*) ELSE {O.dbl(0.0)} END AS cov FROM fact))"
    )


@register("qa_report", _qa_sql())
def q_qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.qa_checks(stages.plain_fact(spark, sf_dir), allowed_years=QA_YEARS).select(
        "check_id", "passed", "severity", "metric", "threshold"
    )


@register(
    "qa_report_totals",
    "SELECT check_id, passed, CAST(count(*) OVER () AS BIGINT) AS total_checks, CAST(count(*) FILTER (WHERE passed) OVER () "
    f"AS BIGINT) AS passed_checks, CAST(count(*) FILTER (WHERE NOT passed) OVER () AS BIGINT) AS failed_checks FROM ({_qa_sql()})",
)
def q_qa_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6 with its totals."""
    columns = ["check_id", "passed", "total_checks", "passed_checks", "failed_checks"]
    return QA.qa_report(stages.plain_fact(spark, sf_dir), allowed_years=QA_YEARS).select(*columns)


@register(
    "qa_required_nulls",
    "SELECT field, null_share, null_share > " + O.dbl(cfg.QA_MAX_NULL_SHARE) + " AS catastrophic FROM (UNPIVOT (SELECT "
    + ", ".join(f"avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END) AS {f}" for f in cfg.QA_REQUIRED_FACT_FIELDS)
    + " FROM fact) ON COLUMNS(*) INTO NAME field VALUE null_share)",
)
def q_qa_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.required_null_shares(stages.plain_fact(spark, sf_dir))


@register(
    "qa_amounts_parsed",
    "SELECT round(CASE WHEN den > 0 THEN num / den ELSE 1.0 END, 4) AS parse_rate, den AS eligible_rows, num AS parsed_rows "
    f"FROM (SELECT count(*) FILTER (WHERE summa IS NOT NULL AND {O.ustrip('summa')} <> '') AS den, "
    f"count(*) FILTER (WHERE summa IS NOT NULL AND {O.ustrip('summa')} <> '' AND ({O.parse_amount('summa')}) IS NOT NULL) AS num FROM seq)",
)
def q_qa_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 on the raw export: share of non-blank raw amounts that parse."""
    from ledgerlens.functions.amounts import parse_amount

    raw = stages.ingested(spark, sf_dir).withColumn("amount_parsed", parse_amount(F.col("summa")))
    checks = QA.qa_checks(raw, amount_column="amount_parsed", raw_amount_column="summa")
    one = raw.agg(
        F.count_if(F.col("summa").isNotNull() & (ustrip(F.col("summa")) != "")).alias("eligible_rows"),
        F.count_if(F.col("summa").isNotNull() & (ustrip(F.col("summa")) != "") & F.col("amount_parsed").isNotNull()).alias("parsed_rows"),
    )
    rate = checks.where(F.col("check_id") == "amounts_parsed").select(F.col("metric").alias("parse_rate"))
    return rate.withColumn("__k", F.lit(1)).join(one.withColumn("__k", F.lit(1)), "__k").drop("__k")


@register(
    "qa_year_bounds",
    "SELECT year FROM (SELECT DISTINCT year FROM fact WHERE year IS NOT NULL) WHERE year NOT IN ("
    + ", ".join(str(y) for y in QA_YEARS) + ")",
)
def q_qa_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = QA.qa_checks(stages.plain_fact(spark, sf_dir), allowed_years=QA_YEARS).where(F.col("check_id") == "year_bounds")
    parsed = checks.select(F.from_json("details", "struct<unexpected_years:array<int>>").alias("d"))
    return parsed.select(F.explode("d.unexpected_years").alias("year"))


@register(
    "qa_confidence_distribution",
    "SELECT coalesce(classification_confidence, 'unclassified') AS classification_confidence, "
    "round(count(*) / (SELECT count(*) FROM fact), 4) AS share FROM fact GROUP BY 1",
)
def q_qa_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.confidence_distribution(stages.plain_fact(spark, sf_dir))


# ---------------------------------------------------------------- 2.8 dashboard

from ledgerlens.operators import audit as AUD  # noqa: E402
from ledgerlens.operators import dashboard as H  # noqa: E402
from ledgerlens.operators import drill as I  # noqa: E402


def _status_label_sql(x: str) -> str:
    cases = " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in cfg.STATUS_LABELS.items())
    return f"(CASE {x} {cases} ELSE {x} END)"


@register(
    "payload_metadata",
    f"SELECT {O.q(cfg.DASHBOARD_TITLE)} AS title, {O.q(cfg.DASHBOARD_CURRENCY)} AS currency, count(*) AS detail_rows_count, "
    "array_to_string(list_sort(list(DISTINCT year) FILTER (WHERE year IS NOT NULL)), ',') AS available_years FROM fact",
)
def q_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.payload_metadata(stages.plain_fact(spark, sf_dir))


_FILTER_PAIRS = [
    ("years", "year"), ("months", "month"), ("statuses", "status_group"), ("categories_l1", "l1_category"),
    ("categories_l2", "l2_category"), ("categories_l3", "l3_category"), ("organizations", "organization_name"),
    ("vendors", "vendor_name"),
]


@register(
    "filter_options",
    "SELECT filter, CASE WHEN filter IN ('months', 'statuses') THEN label ELSE " + O.slug("label") + " END AS id, "
    "CASE WHEN filter = 'months' THEN lpad(label, 2, '0') WHEN filter = 'statuses' THEN " + _status_label_sql("label")
    + " ELSE label END AS label FROM (SELECT DISTINCT filter, label FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS filter, CAST({c} AS VARCHAR) AS label FROM fact" for n, c in _FILTER_PAIRS)
    + ") WHERE label IS NOT NULL AND label <> '')",
)
def q_h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.filter_options(stages.plain_fact(spark, sf_dir))


@register(
    "kpis",
    "SELECT id, label, CAST(value AS DOUBLE) AS value, display FROM (SELECT unnest([ "
    "{'id': 'total_amount', 'label': 'Общая сумма расходов', 'value': round(total, 2), 'display': CAST(round(total, 2) AS VARCHAR)}, "
    "{'id': 'payments_count', 'label': 'Количество операций', 'value': CAST(cnt AS DOUBLE), 'display': CAST(cnt AS VARCHAR)}, "
    "{'id': 'paid_amount', 'label': 'Оплаченные расходы', 'value': round(paid, 2), 'display': CAST(round(paid, 2) AS VARCHAR)}, "
    "{'id': 'unpaid_amount', 'label': 'Неоплаченные и в согласовании', 'value': round(unpaid, 2), 'display': CAST(round(unpaid, 2) AS VARCHAR)}, "
    "{'id': 'review_share', 'label': 'Доля записей на проверку', 'value': sh, 'display': " + O.pct("sh") + "}], recursive := true) FROM ("
    "SELECT CAST(coalesce(sum(CAST(amount AS DECIMAL(28,6))), 0) AS DOUBLE) AS total, count(DISTINCT payment_id) AS cnt, "
    "CAST(coalesce(sum(CAST(amount AS DECIMAL(28,6))) FILTER (WHERE status_group = 'paid'), 0) AS DOUBLE) AS paid, "
    f"CAST(coalesce(sum(CAST(amount AS DECIMAL(28,6))) FILTER (WHERE status_group IN {UNPAID_IN}), 0) AS DOUBLE) AS unpaid, "
    "CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE coalesce(l1_category = 'other_it' OR classification_confidence "
    f"IN ('low', 'unclassified'), false)) / count(*) ELSE {O.dbl(0.0)} END AS sh FROM fact))",
)
def q_h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.kpis(stages.plain_fact(spark, sf_dir))


TREE_SQL = (
    "SELECT CASE g WHEN 3 THEN 'l1' WHEN 1 THEN 'l2' ELSE 'l3' END AS level, l1_category, "
    "CASE WHEN g <= 1 THEN l2_category END AS l2_category, CASE WHEN g = 0 THEN l3_category END AS l3_category, "
    "lbl AS label, " + O.slug("lbl") + " AS id, total_amount, payments_count FROM (SELECT *, coalesce(CAST(CASE g WHEN 3 "
    "THEN l1_category WHEN 1 THEN l2_category ELSE l3_category END AS VARCHAR), '') AS lbl FROM (SELECT l1_category, "
    f"l2_category, l3_category, {O.AMOUNT_AND_COUNT}, grouping(l1_category, l2_category, l3_category) AS g FROM fact "
    "GROUP BY ROLLUP (l1_category, l2_category, l3_category)) WHERE g <> 7)"
)


@register("categories_tree", TREE_SQL)
def q_h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.categories_tree(stages.plain_fact(spark, sf_dir))


@register(
    "status_breakdown",
    f"SELECT status_group AS status_id, {_status_label_sql('status_group')} AS status_label, {O.AMOUNT_AND_COUNT} "
    "FROM fact GROUP BY status_group",
)
def q_h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.status_breakdown(stages.unclassified_fact(spark, sf_dir))


def _entity_sql(col: str) -> str:
    return (
        f"SELECT {O.slug('label')} AS id, label, total_amount, payments_count FROM (SELECT coalesce({col}, '') AS label, "
        f"{O.AMOUNT_AND_COUNT} FROM fact GROUP BY {col})"
    )


@register("vendors_payload", _entity_sql("vendor_name"))
def q_h6v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.entity_aggregate(stages.unclassified_fact(spark, sf_dir), "vendor_name")


@register("organizations_payload", _entity_sql("organization_name"))
def q_h6o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.entity_aggregate(stages.unclassified_fact(spark, sf_dir), "organization_name")


def _tlog_sql() -> str:
    """Transformation log in DuckDB: one UNION ALL branch per logged field."""
    branches = []
    pos = 0
    raw_cols = set(RAW_COLUMNS)
    for fields, rule_id, label in O.AUDIT_GROUPS:
        for field in fields:
            if field not in raw_cols:
                continue
            if field in cfg.AMOUNT_COLUMNS:
                after = O.ser_double(f"c.{field}")
            elif field in cfg.DATE_COLUMNS:
                after = O.ser_ts(f"c.{field}")
            else:
                after = O.ser_str(f"c.{field}")
            before = O.ser_str(f"r.{field}")
            branches.append(
                f"SELECT c._row_seq, {pos} AS base, {O.q(rule_id)} AS rule_id, {O.q(label)} AS rule_label, "
                f"{O.q(field)} AS field, {before} AS before, {after} AS after FROM seq r JOIN classified c USING (_row_seq) "
                f"WHERE {before} <> {after}"
            )
            pos += 1
    rs, mp = O.ser_str("r.registrator_status_name"), O.ser_str("c.business_status")
    branches.append(
        f"SELECT c._row_seq, {pos} AS base, {O.q(O.AUDIT_STATUS[0])}, {O.q(O.AUDIT_STATUS[1])}, 'business_status', "
        f"{rs}, {mp} FROM seq r JOIN classified c USING (_row_seq) WHERE {mp} <> '' AND {rs} <> {mp}"
    )
    pos += 1
    for field in O.DERIVED:
        v = O.ser_str(f"c.{field}")
        branches.append(
            f"SELECT c._row_seq, {pos} AS base, {O.q(O.AUDIT_DERIVED[0])}, {O.q(O.AUDIT_DERIVED[1])}, {O.q(field)}, "
            f"'', {v} FROM classified c WHERE {v} <> ''"
        )
        pos += 1
    return (
        "SELECT 'row_' || CAST(_row_seq AS VARCHAR) AS detail_row_id, CAST(row_number() OVER (PARTITION BY _row_seq "
        "ORDER BY base) - 1 AS INTEGER) AS pos, rule_id, rule_label, field, before, after FROM ("
        + " UNION ALL ".join(branches) + ")"
    )


TLOG_SQL = _tlog_sql()


@register("transformation_log", TLOG_SQL)
def q_h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the log alone, whose fields are cleaned and not classified."""
    return AUD.change_rows(AUD.cleaned_with_raw(stages.ingested(spark, sf_dir)))


@register(
    "audit_join",
    "SELECT 'row_' || CAST(_row_seq AS VARCHAR) AS detail_row_id, CAST(count(t.pos) AS INTEGER) AS n_transformations "
    f"FROM seq LEFT JOIN ({TLOG_SQL}) t ON t.detail_row_id = 'row_' || CAST(seq._row_seq AS VARCHAR) GROUP BY _row_seq",
)
def q_h9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join form over the two separate tables (raw and classified), both of one numbering."""
    raw = stages.ingested(spark, sf_dir)
    joined = AUD.audit_join(raw, D.classify_payments(C.clean_payments(raw, cfg.DEFAULT_CONFIG.statuses), cfg.DEFAULT_CONFIG.rules))
    return joined.select("detail_row_id", F.size("transformations").alias("n_transformations"))


@register(
    "row_raw_attributes",
    "SELECT 'row_' || CAST(_row_seq AS VARCHAR) AS detail_row_id, attribute, value FROM (UNPIVOT (SELECT _row_seq, "
    + ", ".join(f"coalesce({c}, '') AS {c}" for c in RAW_COLUMNS)
    + " FROM seq) ON " + ", ".join(RAW_COLUMNS) + " INTO NAME attribute VALUE value) WHERE value <> ''",
)
def q_h11r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AUD.raw_attribute_rows(stages.ingested(spark, sf_dir))


def _pipeline_attr_sql() -> str:
    parts = []
    for f in O.PIPELINE:
        expr = O.ser_double(f) if f == "classification_confidence_score" else O.ser_str(f)
        parts.append(f"{expr} AS {f}")
    return (
        "SELECT 'row_' || CAST(_row_seq AS VARCHAR) AS detail_row_id, attribute, value FROM (UNPIVOT (SELECT _row_seq, "
        + ", ".join(parts) + " FROM classified) ON " + ", ".join(O.PIPELINE)
        + " INTO NAME attribute VALUE value) WHERE value <> ''"
    )


@register("row_pipeline_attributes", _pipeline_attr_sql())
def q_h11p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AUD.attribute_rows(AUD.audit_trail(stages.ingested(spark, sf_dir)), "pipeline_attributes")


def _details_sql() -> str:
    es = (
        f"CASE WHEN {O.ustrip('contract_name')} <> '' AND {O.ustrip('article_name')} <> '' AND "
        f"lower({O.ustrip('contract_name')}) <> lower({O.ustrip('article_name')}) THEN {O.ustrip('contract_name')} || ' / ' || "
        f"{O.ustrip('article_name')} WHEN {O.ustrip('contract_name')} <> '' THEN {O.ustrip('contract_name')} "
        f"ELSE {O.ustrip('article_name')} END"
    )
    return (
        "SELECT 'row_' || CAST(_row_seq AS VARCHAR) AS detail_row_id, _row_seq, payment_id, "
        "coalesce(strftime(period_date, '%Y-%m-%d'), '') AS period_date, year, month, quarter, amount, status_group, "
        f"article_name, article_code, contract_name, {es} AS expense_subject, {O.slug('vendor_name')} AS vendor_id, "
        f"vendor_name AS vendor_label, {O.slug('organization_name')} AS organization_id, organization_name AS "
        "organization_label, project_name, department_name, "
        f"{O.slug('l1_category')} AS l1_category_id, l1_category AS l1_category_label, {O.slug('l2_category')} AS "
        f"l2_category_id, l2_category AS l2_category_label, {O.slug('l3_category')} AS l3_category_id, l3_category AS "
        "l3_category_label, classification_confidence, matched_rule_id, matched_keywords, matched_vendor_pattern, "
        "matched_article_pattern, classification_reason_human, "
        f"{HAS_SQL} AS has_transformations FROM fact JOIN ({CHANGED_SQL}) USING (_row_seq)"
    )


def _changed_sql() -> str:
    """One pass over raw and processed rows: did any logged field change."""
    tests = []
    for fields, _, _ in O.AUDIT_GROUPS:
        for field in set(fields) & set(RAW_COLUMNS):
            serial = O.ser_double if field in cfg.AMOUNT_COLUMNS else O.ser_ts if field in cfg.DATE_COLUMNS else O.ser_str
            tests.append(f"{O.ser_str(f'r.{field}')} <> {serial(f'c.{field}')}")
    raw_status, status = O.ser_str("r.registrator_status_name"), O.ser_str("c.business_status")
    tests.append(f"({status} <> '' AND {raw_status} <> {status})")
    tests += [f"{O.ser_str(f'c.{field}')} <> ''" for field in O.DERIVED]
    return "SELECT _row_seq, " + " OR ".join(sorted(tests)) + " AS changed FROM seq r JOIN classified c USING (_row_seq)"


HAS_SQL, CHANGED_SQL = "changed", _changed_sql()
DETAILS_SQL = _details_sql()


def details_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = AUD.processed_with_raw(stages.ingested(spark, sf_dir))
    return H.detail_rows(written(E.build_payments_fact(AUD.without_raw(staged)), "fact"))


PLAIN_DETAILS_SQL = DETAILS_SQL.replace(
    f", {HAS_SQL} AS has_transformations FROM fact JOIN ({CHANGED_SQL}) USING (_row_seq)", " FROM fact"
)


@register("detail_rows", DETAILS_SQL)
def q_h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: the detail rows with all their 32 columns."""
    return details_frame(spark, sf_dir)


@register(
    "detail_transformed",
    f"SELECT 'row_' || CAST(_row_seq AS VARCHAR) AS detail_row_id, {HAS_SQL} AS has_transformations FROM ({CHANGED_SQL})",
)
def q_h7_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details_frame(spark, sf_dir).select("detail_row_id", "has_transformations")


@register(
    "detail_row_index",
    "SELECT DISTINCT key, detail_row_id, _row_seq FROM (SELECT unnest([" + ", ".join(
        f"'{p}:' || coalesce(CAST({c} AS VARCHAR), 'None')"
        for p, c in [("year", "year"), ("month", "month"), ("status", "status_group"), ("organization", "organization_id"),
                     ("vendor", "vendor_id"), ("l1", "l1_category_id"), ("l2", "l2_category_id"), ("l3", "l3_category_id")]
    ) + f"]) AS key, detail_row_id, _row_seq FROM ({PLAIN_DETAILS_SQL}))",
)
def q_h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.detail_row_index(H.detail_rows(stages.written_fact(spark, sf_dir)))


@register(
    "slugify",
    "SELECT label, " + O.slug("label") + " AS slug FROM (SELECT DISTINCT coalesce(vendor_name, '') AS label FROM fact "
    "UNION SELECT DISTINCT coalesce(organization_name, '') FROM fact UNION SELECT DISTINCT coalesce(article_name, '') FROM fact)",
)
def q_h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.functions.slug import slug_table

    return slug_table(stages.plain_fact(spark, sf_dir), ["vendor_name", "organization_name", "article_name"])


@register(
    "expense_subject",
    "SELECT _row_seq, expense_subject FROM (" + DETAILS_SQL.replace(
        f"{HAS_SQL} AS has_transformations FROM fact JOIN ({CHANGED_SQL}) USING (_row_seq)", "1 AS x FROM fact"
    ) + ")",
)
def q_h13(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stages.fact(spark, sf_dir)
    return f.select(ROW_SEQ, H.expense_subject(F.col("contract_name"), F.col("article_name")).alias("expense_subject"))


# ---------------------------------------------------------------- 2.9 drill-down

DRILL_YEAR = YEARS[0]


def _details_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.detail_rows(stages.written_fact(spark, sf_dir))


DET_LIGHT = "(" + DETAILS_SQL.replace(
    f"{HAS_SQL} AS has_transformations FROM fact JOIN ({CHANGED_SQL}) USING (_row_seq)",
    "false AS has_transformations FROM fact",
) + ")"


@register(
    "detail_filter",
    f"SELECT detail_row_id, amount, vendor_id, l1_category_id FROM {DET_LIGHT} WHERE CAST(year AS VARCHAR) = '{DRILL_YEAR}' "
    "AND status_group = 'paid' AND l1_category_id = 'infrastructure'",
)
def q_i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.detail_filter(_details_light(spark, sf_dir), year=DRILL_YEAR, status_group="paid", l1_category_id="infrastructure")
    return d.select("detail_row_id", "amount", "vendor_id", "l1_category_id")


@register(
    "detail_search",
    "SELECT detail_row_id, amount FROM " + DET_LIGHT + " WHERE contains(lower(concat_ws(' ', "
    + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in O.SEARCHED) + ")), 'kaspersky')",
)
def q_i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.detail_search(_details_light(spark, sf_dir), "Kaspersky").select("detail_row_id", "amount")


@register(
    "detail_sort_page",
    f"SELECT detail_row_id, amount FROM {DET_LIGHT} ORDER BY amount DESC, _row_seq LIMIT 10 OFFSET 10",
)
def q_i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3 + I4: default sort (amount desc), page 2 of 10 rows."""
    ordered = I.detail_sort(_details_light(spark, sf_dir), "amount")
    return I.detail_page(ordered, 2).select("detail_row_id", "amount")


@register(
    "detail_export",
    "SELECT coalesce(period_date, '') AS period_date, coalesce(vendor_label, '') AS vendor_label, coalesce(organization_label, '') "
    "AS organization_label, coalesce(expense_subject, '') AS expense_subject, coalesce(project_name, '') AS project_name, "
    "coalesce(classification_confidence, '') AS classification_confidence, coalesce(classification_reason_human, '') AS "
    f"classification_reason_human, {_status_label_sql('status_group')} AS status_group, {O.fmt_k('amount')} AS amount FROM "
    f"{DET_LIGHT} WHERE l1_category_id = 'communications'",
)
def q_i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.detail_filter(_details_light(spark, sf_dir), l1_category_id="communications")
    return I.export_frame(d)


@register(
    "category_ranking",
    f"SELECT id, label, total_amount FROM ({TREE_SQL}) WHERE level = 'l1' ORDER BY total_amount DESC, label LIMIT 8",
)
def q_i6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.category_ranking(H.categories_tree(stages.plain_fact(spark, sf_dir)))


def yoy_sql(details: str) -> str:
    return (
        "SELECT label, id, left_year, right_year, previous_amount, current_amount, current_amount - previous_amount AS "
        "delta_amount, CASE WHEN previous_amount <> 0 THEN (current_amount - previous_amount) / previous_amount ELSE "
        f"{O.dbl(1.0)} END AS delta_share FROM (SELECT label, first(l1_category_id ORDER BY _row_seq) AS id, any_value(ly) AS "
        "left_year, any_value(ry) AS right_year, CAST(coalesce(sum(CAST(amount AS DECIMAL(28,6))) FILTER (WHERE year = ly), 0) "
        "AS DOUBLE) AS previous_amount, CAST(coalesce(sum(CAST(amount AS DECIMAL(28,6))) FILTER (WHERE year = ry), 0) AS DOUBLE) "
        "AS current_amount FROM (SELECT CASE WHEN coalesce(l1_category_label, '') = '' THEN 'Прочее' ELSE l1_category_label END "
        f"AS label, l1_category_id, year, amount, _row_seq, (SELECT min(year) FROM {details}) AS ly, (SELECT max(year) FROM "
        f"{details}) AS ry FROM {details}) GROUP BY label)"
    )


YOY_SQL = yoy_sql(DET_LIGHT)
#: The span of years a reader compares, both whole in the given tables.
YOY_SPAN = (1996, 1997)


@register("category_yoy", f"SELECT * FROM ({YOY_SQL}) ORDER BY abs(delta_amount) DESC, label LIMIT 8")
def q_i7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.category_yoy(_details_light(spark, sf_dir))


@register("growth_leader", f"SELECT * FROM ({YOY_SQL}) WHERE delta_amount > 0 ORDER BY delta_amount DESC, label LIMIT 1")
def q_i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.growth_leader(_details_light(spark, sf_dir))


@register(
    "growth_leader_of_years",
    f"SELECT * FROM ({yoy_sql(f'(SELECT * FROM {DET_LIGHT} WHERE year BETWEEN {YOY_SPAN[0]} AND {YOY_SPAN[1]})')}) "
    "WHERE delta_amount > 0 ORDER BY delta_amount DESC, label LIMIT 1",
)
def q_i8_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.growth_leader(_details_light(spark, sf_dir).where(F.col("year").between(*YOY_SPAN)))


@register(
    "category_yoy_of_years",
    f"SELECT * FROM ({yoy_sql(f'(SELECT * FROM {DET_LIGHT} WHERE year BETWEEN {YOY_SPAN[0]} AND {YOY_SPAN[1]})')}) "
    "ORDER BY abs(delta_amount) DESC, label LIMIT 8",
)
def q_i7_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.category_yoy(_details_light(spark, sf_dir).where(F.col("year").between(*YOY_SPAN)))


@register(
    "stuck_amount",
    f"SELECT CAST(coalesce(sum(CAST(amount AS DECIMAL(28,6))) FILTER (WHERE status_group IN {UNPAID_IN}), 0) AS DOUBLE) "
    "AS stuck_amount FROM fact",
)
def q_i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stuck_amount(stages.plain_fact(spark, sf_dir))


@register(
    "group_amounts",
    f"SELECT vendor_name AS key, {O.exact_sum('amount')} AS total_amount FROM fact WHERE coalesce(vendor_name, '') <> '' "
    "GROUP BY 1",
)
def q_i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.group_amounts(stages.plain_fact(spark, sf_dir), "vendor_name")


@register(
    "top_departments",
    "SELECT label, total_amount FROM (SELECT CASE WHEN coalesce(department_name, '') = '' THEN 'unknown' ELSE "
    f"department_name END AS label, {O.exact_sum('amount')} AS total_amount FROM fact GROUP BY 1) "
    "ORDER BY total_amount DESC, label LIMIT 10",
)
def q_i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.top_departments(stages.plain_fact(spark, sf_dir))


@register(
    "entity_top10",
    f"SELECT * FROM ({_entity_sql('vendor_name')}) ORDER BY label LIMIT 10",
)
def q_i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.entity_top10(H.entity_aggregate(stages.unclassified_fact(spark, sf_dir), "vendor_name"))


@register(
    "treemap_flatten",
    "SELECT CASE level WHEN 'l1' THEN p1 WHEN 'l2' THEN p2 ELSE p2 || '|l3:' || id || ':' || label END AS path, "
    "CASE level WHEN 'l1' THEN '' WHEN 'l2' THEN p1 ELSE p2 END AS parent, label, total_amount AS value FROM ("
    "SELECT t.*, 'l1:' || a.id || ':' || a.label AS p1, 'l1:' || a.id || ':' || a.label || '|l2:' || b.id || ':' || b.label "
    f"AS p2 FROM ({TREE_SQL}) t LEFT JOIN (SELECT * FROM ({TREE_SQL}) WHERE level = 'l1') a ON t.l1_category = a.l1_category "
    f"LEFT JOIN (SELECT * FROM ({TREE_SQL}) WHERE level = 'l2') b ON t.l1_category = b.l1_category AND t.l2_category = "
    "b.l2_category)",
)
def q_i13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.treemap_paths(H.categories_tree(stages.plain_fact(spark, sf_dir)))


@register(
    "insight_drill",
    f"SELECT d.detail_row_id, d.amount FROM {DET_LIGHT} d JOIN ({F1_SQL}) i ON d.l1_category_id = "
    + O.slug("json_extract_string(i.filters_json, '$.l1_category[0]')"),
)
def q_i14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I14 driven by the top-category insight's filters (one small action
    reads the one-row insight, as the UI does on click)."""
    fact = stages.written_fact(spark, sf_dir)
    top = INS.top_spend_category(fact).select("supporting_filters").first()
    filters = dict(top["supporting_filters"] or {}) if top else {}
    return I.insight_drill(H.detail_rows(fact), filters).select("detail_row_id", "amount")


@register(
    "kpi_drill",
    f"SELECT detail_row_id, amount FROM {DET_LIGHT} WHERE status_group = 'approved_not_paid'",
)
def q_i15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.kpi_drill(_details_light(spark, sf_dir), "unpaid_amount").select("detail_row_id", "amount")


@register(
    "row_detail",
    f"SELECT detail_row_id, pos, rule_id, rule_label, field, before, after FROM ({TLOG_SQL}) WHERE detail_row_id = 'row_42'",
)
def q_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: one row, found by its place in the order without numbering the others."""
    row = row_at(stages.ingested(spark, sf_dir, numbered=False), 42, RAW_COLUMNS)
    return AUD.transformation_rows(I.row_detail(AUD.audit_trail(row), "row_42"))


@register(
    "monthly_series",
    f"SELECT year, month, total_amount / {O.dbl(1000.0)} AS amount_thousands, payments_count FROM "
    f"(SELECT year, month, {O.AMOUNT_AND_COUNT} FROM fact GROUP BY year, month)",
)
def q_i17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.monthly_series(E.build_agg_kpi_year_month(stages.unclassified_fact(spark, sf_dir)))


# ---------------------------------------------------------------- D19 labels -> rules

from ledgerlens.operators.labels import labels_to_rules  # noqa: E402

_MAX_PRIORITY = max([int(r["priority"]) for r in cfg.CLASSIFICATION_RULES] + [190])
_EXISTING_IDS = ", ".join(O.q(r["rule_id"]) for r in cfg.CLASSIFICATION_RULES)
_CLEAN = lambda c: (
    f"CASE WHEN {O.ustrip(f'coalesce({c}, {O.q(str())})')} <> '' AND lower({O.ustrip(f'coalesce({c}, {O.q(str())})')}) <> 'nan' "
    f"THEN lower({O.ustrip(f'coalesce({c}, {O.q(str())})')}) ELSE '' END"
)


def _labels_sql() -> str:
    rid = (
        "trim(regexp_replace(concat_ws('_', " + ", ".join(
            f"CASE WHEN {O.ustrip(f'coalesce(suggested_{x}, {O.q(str())})')} <> '' THEN lower({O.ustrip(f'suggested_{x}')}) END"
            for x in ("l1", "l2", "l3")
        ) + "), '[^0-9a-z_]+', '_', 'g'), '_')"
    )
    conds = (
        "list_filter([" + ", ".join(
            f"CASE WHEN {_CLEAN(src)} <> '' THEN {{'column': '{col}', 'match_type': 'contains_any', 'values': [{_CLEAN(src)}]}} END"
            for src, col in [("raw_article", "bit_stati_oborotov_naimenovanie"), ("raw_description", "naznachenie_platezha"),
                             ("raw_vendor", "kontragenti_naimenovanie")]
        ) + "], lambda x: x IS NOT NULL)"
    )
    return (
        f"SELECT rule_id, CAST({_MAX_PRIORITY + 10} + 10 * (row_number() OVER (ORDER BY n) - 1) AS INTEGER) AS priority, "
        "confidence, l1, l2, l3, to_json(conditions) AS conditions, " + O.dbl(0.75) + " AS review_required_below FROM ("
        "SELECT rule_id, min(n) AS n, arg_min(confidence, n) AS confidence, arg_min(l1, n) AS l1, arg_min(l2, n) AS l2, "
        "arg_min(l3, n) AS l3, arg_min(conditions, n) AS conditions FROM ("
        f"SELECT CASE WHEN {rid} <> '' THEN {rid} ELSE 'manual_review_rule_' || CAST(n AS VARCHAR) END AS rule_id, n, "
        f"{O.dbl(0.82)} AS confidence, {O.ustrip('suggested_l1')} AS l1, {O.ustrip('suggested_l2')} AS l2, "
        f"{O.ustrip('suggested_l3')} AS l3, CASE WHEN len({conds}) > 0 THEN {conds} ELSE "
        "[{'column': 'bit_stati_oborotov_naimenovanie', 'match_type': 'contains_any', 'values': ['*']}] END AS conditions "
        f"FROM (SELECT *, row_number() OVER (ORDER BY _row_seq) AS n FROM ({REVIEW_SQL})) "
        f"WHERE {O.ustrip(f'coalesce(suggested_l1, {O.q(str())})')} <> '' AND {O.ustrip(f'coalesce(suggested_l2, {O.q(str())})')} <> '' "
        f"AND {O.ustrip(f'coalesce(suggested_l3, {O.q(str())})')} <> '') WHERE rule_id NOT IN ({_EXISTING_IDS}) GROUP BY rule_id)"
    )


@register("labels_to_rules", _labels_sql())
def q_d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the rows of the queue are put in the order of the raw columns."""
    staged = D.classify_payments(AUD.cleaned_with_raw(stages.ingested(spark, sf_dir, numbered=False)), cfg.DEFAULT_CONFIG.rules)
    order = [AUD.RAW_PREFIX + c for c in RAW_COLUMNS]
    queue = with_row_seq(written(D.build_review_queue(staged, keep=order), "queue"), order).drop(*order)
    rules = labels_to_rules(queue, cfg.CLASSIFICATION_RULES)
    return rules.withColumn("conditions", F.to_json("conditions"))


@register("classify_payments_join", f"SELECT _row_seq, {CLASS_COLS} FROM classified")
def q_classify_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17 through the join form (distinct feature tuples x broadcast patterns)."""
    return D.classify_payments_join(stages.cleaned(spark, sf_dir)).select(ROW_SEQ, *D.CLASSIFICATION_OUTPUT_COLUMNS)


# the same rules with lower confidences, so that every confidence bucket occurs
LOWER_RULES = [{**rule, "confidence": (0.9, 0.6, 0.3)[i % 3]} for i, rule in enumerate(cfg.CLASSIFICATION_RULES)]


@register("classify_payments_lower")
def q_classify_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4-D18 under rules that give high, medium and low confidences."""
    return D.classify_payments(stages.cleaned(spark, sf_dir), LOWER_RULES).select(ROW_SEQ, *D.CLASSIFICATION_OUTPUT_COLUMNS)


ORACLES["classify_payments_lower"] = O.with_ctes(f"SELECT _row_seq, {CLASS_COLS} FROM classified", LOWER_RULES)


@register(
    "fact_scan",
    "SELECT year, count(*) AS rows, CAST(count(DISTINCT payment_id) AS BIGINT) AS payments FROM fact "
    f"WHERE year = {YEARS[0]} GROUP BY year",
)
def q_fact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + A6: the fact written by year, read back with the year pruned."""
    path = f"{shared_dir(spark).rstrip('/')}/fact-{uuid.uuid4().hex}"
    sinks.write_parquet(stages.plain_fact(spark, sf_dir), path, ["year"])
    one = sinks.read_fact(spark, path).where(F.col("year") == YEARS[0])
    return one.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("payment_id").alias("payments"))


@register("select_base_period", "SELECT _row_seq, period AS base_period FROM clean")
def q_base_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the first existing period column of the cleaned rows."""
    cleaned = stages.cleaned(spark, sf_dir)
    return cleaned.select(ROW_SEQ, C.base_period(cleaned).alias("base_period"))


from ledgerlens.plans import catalog_stored  # noqa: E402, F401  (registers the queries of written tables)
