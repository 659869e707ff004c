"""Interactive drill-down queries (I1-I17), formerly run in the browser over
every detail row; here they are DataFrame queries over the detail table
(``dashboard.detail_rows``) or the fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import config as cfg
from ledgerlens.functions.amounts import exact_sum
from ledgerlens.functions.formatting import amount_thousands
from ledgerlens.functions.slug import slugify_text
from ledgerlens.operators.dashboard import status_label
from ledgerlens.sources.ingest import ROW_SEQ

FILTER_FIELDS = [
    "year",
    "month",
    "status_group",
    "l1_category_id",
    "l2_category_id",
    "l3_category_id",
    "vendor_id",
    "organization_id",
    "classification_confidence",
]
SEARCH_FIELDS = [
    "vendor_label",
    "organization_label",
    "expense_subject",
    "article_name",
    "contract_name",
    "project_name",
    "department_name",
    "l1_category_label",
    "l2_category_label",
    "l3_category_label",
    "classification_reason_human",
]
SORT_FIELDS = [
    "period_date",
    "vendor_label",
    "organization_label",
    "expense_subject",
    "project_name",
    "classification_confidence",
    "classification_reason_human",
    "status_group",
    "amount",
]
EXPORT_COLUMNS = SORT_FIELDS


def detail_filter(details: DataFrame, **filters: object) -> DataFrame:
    """AND of equality predicates (values compared as text, like the UI).
    A list value becomes an IN predicate."""
    out = details
    for field, value in filters.items():
        if field not in FILTER_FIELDS or value in (None, ""):
            continue
        col = F.col(field).cast("string")
        if isinstance(value, (list, tuple, set)):
            out = out.where(col.isin([str(v) for v in value]))
        else:
            out = out.where(col == F.lit(str(value)))
    return out


def detail_search(details: DataFrame, text: str) -> DataFrame:
    """Lower-cased substring over 11 fields joined by a space."""
    if not text:
        return details
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCH_FIELDS]))
    return details.where(F.contains(hay, F.lit(text.lower())))


def detail_sort(details: DataFrame, key: str = "amount", ascending: bool | None = None,
                collation: str | None = None) -> DataFrame:
    """Order by one column (amount defaults to descending), row order as
    tiebreak; optional collation (e.g. 'UNICODE') for text columns."""
    if key not in SORT_FIELDS:
        raise ValueError(f"Unsupported sort key: {key}")
    asc = (key != "amount") if ascending is None else ascending
    col = F.col(key)
    if collation and key != "amount":
        col = F.collate(col.cast("string"), collation)
    return details.orderBy(col.asc() if asc else col.desc(), F.col(ROW_SEQ).asc())


def detail_page(sorted_details: DataFrame, page: int, page_size: int = cfg.DETAIL_PAGE_SIZE,
                total_rows: int | None = None) -> DataFrame:
    """I4: one page (1-based, clamped to the last page)."""
    if total_rows is None:
        total_rows = sorted_details.count()
    pages = max(1, -(-total_rows // page_size))
    page = min(max(1, int(page)), pages)
    return sorted_details.offset((page - 1) * page_size).limit(page_size)


def export_frame(details: DataFrame) -> DataFrame:
    """The nine export columns with status label and formatted amount."""
    cols = []
    for c in EXPORT_COLUMNS:
        if c == "amount":
            cols.append(amount_thousands(F.col(c)).alias(c))
        elif c == "status_group":
            cols.append(status_label(F.col(c)).alias(c))
        else:
            cols.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
    return details.select(*cols)


def detail_export(details: DataFrame, path: str) -> str:
    """I5 sink: every cell quoted."""
    export_frame(details).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    return path


def category_ranking(tree: DataFrame, top: int = 8) -> DataFrame:
    """L1 categories by total, descending, top 8."""
    return (
        tree.where(F.col("level") == "l1")
        .select("id", "label", "total_amount")
        .orderBy(F.col("total_amount").desc(), F.col("label"))
        .limit(top)
    )


def category_yoy(details: DataFrame, top: int | None = 8) -> DataFrame:
    """First vs last year present; per L1 label: previous, current, delta
    and share (delta / previous, or 1 when previous is 0); by |delta| desc."""
    years = details.where(F.col("year").isNotNull()).agg(
        F.min("year").alias("left_year"), F.max("year").alias("right_year")
    ).withColumn("__k", F.lit(1))
    label = F.when(F.coalesce(F.col("l1_category_label"), F.lit("")) == "", F.lit("Прочее")).otherwise(
        F.col("l1_category_label")
    )
    rows = details.select(label.alias("label"), "l1_category_id", "year", "amount", ROW_SEQ).withColumn("__k", F.lit(1))
    joined = rows.join(F.broadcast(years), "__k")
    amount = F.col("amount")
    grouped = joined.groupBy("label").agg(
        F.min_by("l1_category_id", ROW_SEQ).alias("id"),
        F.first("left_year").alias("left_year"),
        F.first("right_year").alias("right_year"),
        exact_sum(F.when(F.col("year") == F.col("left_year"), amount)).alias("previous_amount"),
        exact_sum(F.when(F.col("year") == F.col("right_year"), amount)).alias("current_amount"),
    )
    out = grouped.withColumn("delta_amount", F.col("current_amount") - F.col("previous_amount")).withColumn(
        "delta_share",
        F.when(F.col("previous_amount") != 0, F.col("delta_amount") / F.col("previous_amount")).otherwise(F.lit(1.0)),
    )
    out = out.orderBy(F.abs(F.col("delta_amount")).desc(), F.col("label"))
    return out.limit(top) if top else out


def growth_leader(details: DataFrame) -> DataFrame:
    """I8: the largest positive delta of I7 (zero or one row)."""
    return (
        category_yoy(details, top=None)
        .where(F.col("delta_amount") > 0)
        .orderBy(F.col("delta_amount").desc(), F.col("label"))
        .limit(1)
    )


def stuck_amount(details: DataFrame) -> DataFrame:
    """Approved-not-paid plus in-approval total."""
    return details.agg(
        exact_sum(F.when(F.col("status_group").isin(*cfg.UNPAID_STATUSES), F.col("amount"))).alias("stuck_amount")
    )


def group_amounts(details: DataFrame, field: str) -> DataFrame:
    """Sum by field, blank keys dropped, descending."""
    key = F.coalesce(F.col(field).cast("string"), F.lit(""))
    return (
        details.where(key != "")
        .groupBy(key.alias("key"))
        .agg(exact_sum(F.col("amount")).alias("total_amount"))
        .orderBy(F.col("total_amount").desc(), F.col("key"))
    )


def top_departments(details: DataFrame, top: int = 10) -> DataFrame:
    """Sum by department (blank -> 'unknown'), top 10."""
    label = F.when(F.coalesce(F.col("department_name"), F.lit("")) == "", F.lit("unknown")).otherwise(F.col("department_name"))
    return (
        details.groupBy(label.alias("label"))
        .agg(exact_sum(F.col("amount")).alias("total_amount"))
        .orderBy(F.col("total_amount").desc(), F.col("label"))
        .limit(top)
    )


def entity_top10(entity_payload: DataFrame, by: str = "name", top: int = 10) -> DataFrame:
    """First 10 of the vendor / organisation payload; the payload is
    sorted by name (reference order); ``by='total'`` gives top by spend."""
    if by == "total":
        return entity_payload.orderBy(F.col("total_amount").desc(), F.col("label")).limit(top)
    return entity_payload.orderBy(F.col("label")).limit(top)


def insight_drill(details: DataFrame, supporting_filters: dict[str, object]) -> DataFrame:
    """Insight filters -> detail predicates (status, vendor, org, L1 via
    slug, last year of a year list).  A list of statuses becomes IN."""
    f = supporting_filters or {}
    conds = {}
    if f.get("status_group"):
        conds["status_group"] = f["status_group"]
    if f.get("vendor_name"):
        conds["vendor_id"] = slugify_text(_scalar(f["vendor_name"]))
    if f.get("organization_name"):
        conds["organization_id"] = slugify_text(_scalar(f["organization_name"]))
    if f.get("l1_category"):
        conds["l1_category_id"] = slugify_text(_scalar(f["l1_category"]))
    years = f.get("year")
    if isinstance(years, (list, tuple)) and years:
        conds["year"] = str(years[-1])
    return detail_filter(details, **conds)


def _scalar(value: object) -> str:
    if isinstance(value, (list, tuple)):
        return str(value[0]) if value else ""
    return str(value)


def kpi_drill(details: DataFrame, kpi_id: str, exact: bool = False) -> DataFrame:
    """KPI card -> filter.  Reference form: paid -> paid, unpaid ->
    approved_not_paid only, review_share -> confidence unclassified only;
    ``exact=True`` uses the KPI's own definition."""
    if kpi_id == "paid_amount":
        return detail_filter(details, status_group="paid")
    if kpi_id == "unpaid_amount":
        return detail_filter(details, status_group=cfg.UNPAID_STATUSES if exact else "approved_not_paid")
    if kpi_id == "review_share":
        if exact:
            return details.where(
                (F.col("l1_category_label") == cfg.FACT_DEFAULT_L1)
                | F.col("classification_confidence").isin("low", "unclassified")
            )
        return detail_filter(details, classification_confidence="unclassified")
    return details


def row_detail(audit: DataFrame, detail_row_id: str) -> DataFrame:
    """I16: one row's audit record (point filter)."""
    return audit.where(F.col("detail_row_id") == F.lit(detail_row_id))


def monthly_series(agg_kpi_year_month: DataFrame) -> DataFrame:
    """Monthly totals in thousands, one series per year (long form)."""
    return agg_kpi_year_month.select(
        "year", "month", (F.col("total_amount") / F.lit(1000.0)).alias("amount_thousands"), "payments_count"
    )
