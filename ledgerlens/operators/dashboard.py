"""Dashboard payload sections (H1-H15) as flat, distributed tables.

The studied tool embeds one JSON document holding every row; here each
section is its own DataFrame (and sink), so nothing passes whole through the
driver.  Slugs come from ``attach_slugs`` (distinct labels only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import config as cfg
from ledgerlens.functions.amounts import exact_sum
from ledgerlens.functions.dates import iso_date_text
from ledgerlens.functions.formatting import percent1
from ledgerlens.functions.slug import attach_label_slugs, attach_slugs
from ledgerlens.functions.text import ustrip
from ledgerlens.operators import marts
from ledgerlens.operators.marts import HAS_TRANSFORMATIONS
from ledgerlens.sources.ingest import ROW_SEQ


def status_label(col: Column) -> Column:
    """Russian status label; unknown ids map to themselves."""
    labels = F.create_map(*[x for k, v in cfg.STATUS_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(labels, col), col)


def payload_metadata(fact: DataFrame) -> DataFrame:
    """H1: title, currency, row count, sorted distinct years (no timestamp)."""
    return fact.agg(
        F.lit(cfg.DASHBOARD_TITLE).alias("title"),
        F.lit(cfg.DASHBOARD_CURRENCY).alias("currency"),
        F.count(F.lit(1)).alias("detail_rows_count"),
        F.array_join(F.array_sort(F.collect_set(F.col("year").cast("int"))), ",").alias("available_years"),
    )


def filter_options(fact: DataFrame) -> DataFrame:
    """H2: (filter, id, label) for years, months, statuses, L1-L3, orgs, vendors.

    One pass: every row emits its (filter, value) pairs, distinct runs as a
    partially aggregated shuffle, blanks are dropped, then slugs are added on
    the distinct labels only."""
    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("filter"), value.cast("string").alias("label"))

    pairs = fact.select(
        F.explode(
            F.array(
                pair("years", F.col("year")),
                pair("months", F.col("month")),
                pair("statuses", F.col("status_group")),
                pair("categories_l1", F.col("l1_category")),
                pair("categories_l2", F.col("l2_category")),
                pair("categories_l3", F.col("l3_category")),
                pair("organizations", F.col("organization_name")),
                pair("vendors", F.col("vendor_name")),
            )
        ).alias("p")
    ).select("p.filter", "p.label")
    distinct = pairs.where(F.col("label").isNotNull() & (F.col("label") != "")).distinct()
    slugged = attach_slugs(distinct, [("label", "slug")])
    month_int = F.col("label").cast("int")
    return slugged.select(
        "filter",
        F.when(F.col("filter").isin("months", "statuses"), F.col("label")).otherwise(F.col("slug")).alias("id"),
        F.when(F.col("filter") == "months", F.lpad(month_int.cast("string"), 2, "0"))
        .when(F.col("filter") == "statuses", status_label(F.col("label")))
        .otherwise(F.col("label"))
        .alias("label"),
    )


def kpis(fact: DataFrame) -> DataFrame:
    """H3: headline KPIs in one aggregation: (id, label, value, display)."""
    from ledgerlens.operators.audit import py_float_text

    amount = F.col("amount")
    review = (F.col("l1_category") == cfg.FACT_DEFAULT_L1) | F.col("classification_confidence").isin("low", "unclassified")
    one = fact.agg(
        F.count(F.lit(1)).alias("n"),
        exact_sum(amount).alias("total"),
        F.countDistinct("payment_id").alias("cnt"),
        exact_sum(F.when(F.col("status_group") == "paid", amount)).alias("paid"),
        exact_sum(F.when(F.col("status_group").isin(*cfg.UNPAID_STATUSES), amount)).alias("unpaid"),
        F.count_if(F.coalesce(review, F.lit(False))).alias("review"),
    )
    share = F.when(F.col("n") > 0, F.col("review") / F.col("n")).otherwise(F.lit(0.0))

    def row(kid: str, label: str, value: Column, display: Column) -> Column:
        return F.struct(F.lit(kid).alias("id"), F.lit(label).alias("label"), value.cast("double").alias("value"),
                        display.alias("display"))

    return one.select(
        F.inline(
            F.array(
                row("total_amount", "Общая сумма расходов", F.round("total", 2), py_float_text(F.round("total", 2))),
                row("payments_count", "Количество операций", F.col("cnt"), F.col("cnt").cast("string")),
                row("paid_amount", "Оплаченные расходы", F.round("paid", 2), py_float_text(F.round("paid", 2))),
                row("unpaid_amount", "Неоплаченные и в согласовании", F.round("unpaid", 2), py_float_text(F.round("unpaid", 2))),
                row("review_share", "Доля записей на проверку", share, percent1(share)),
            )
        )
    )


def categories_tree(fact: DataFrame, cube: DataFrame | None = None) -> DataFrame:
    """H4: L1 / L2 / L3 totals and distinct payment counts per level, each level a
    grouping of ``cube`` (a written marts.aggregate_cube; by default that of the
    tree's levels).  Rows: level, l1, l2, l3, id, label, total_amount,
    payments_count; parent counts are their own distinct counts."""
    if cube is None:
        cube = marts.aggregate_cube(fact, TREE_LEVELS)
    levels = F.create_map(*[x for name, level in TREE_LEVELS.items() for x in (F.lit(name), F.lit(level))])
    rows = cube.withColumn("level", F.element_at(levels, F.col("grouping"))).where(F.col("level").isNotNull())
    label = F.when(F.col("level") == "l1", F.col("l1_category")).when(F.col("level") == "l2", F.col("l2_category")).otherwise(
        F.col("l3_category")
    )
    flat = rows.select(
        "level", "l1_category", "l2_category", "l3_category", F.coalesce(label.cast("string"), F.lit("")).alias("label"),
        "total_amount", "payments_count",
    )
    return attach_slugs(flat, [("label", "id")])


TREE_LEVELS = {"tree_l1": "l1", "tree_l2": "l2", "agg_categories": "l3"}


def treemap_paths(tree: DataFrame) -> DataFrame:
    """(id path, parent path, label, value) with 'level:id:label' parts joined by '|'."""
    node = lambda lvl, idc, lab: F.concat(F.lit(lvl + ":"), idc, F.lit(":"), lab)
    l1 = tree.where(F.col("level") == "l1").select(
        "l1_category", F.col("id").alias("id1"), F.col("label").alias("lab1")
    )
    l2 = tree.where(F.col("level") == "l2").select(
        "l1_category", "l2_category", F.col("id").alias("id2"), F.col("label").alias("lab2")
    )
    with_parents = (
        tree.join(l1, "l1_category", "left")
        .join(l2, ["l1_category", "l2_category"], "left")
    )
    p1 = node("l1", F.col("id1"), F.col("lab1"))
    p2 = F.concat(p1, F.lit("|"), node("l2", F.col("id2"), F.col("lab2")))
    own = node("l3", F.col("id"), F.col("label"))
    path = (
        F.when(F.col("level") == "l1", p1)
        .when(F.col("level") == "l2", p2)
        .otherwise(F.concat(p2, F.lit("|"), own))
    )
    parent = F.when(F.col("level") == "l1", F.lit("")).when(F.col("level") == "l2", p1).otherwise(p2)
    return with_parents.select(
        path.alias("path"), parent.alias("parent"), "label", F.col("total_amount").alias("value")
    )


def status_breakdown(fact: DataFrame, agg: DataFrame | None = None) -> DataFrame:
    """H5: agg_status (of the fact, where it is not given) with Russian labels."""
    agg = marts.build_agg_status(fact) if agg is None else agg
    return agg.select(
        F.col("status_group").cast("string").alias("status_id"),
        status_label(F.col("status_group").cast("string")).alias("status_label"),
        "total_amount",
        "payments_count",
    )


def entity_aggregate(fact: DataFrame, column: str, agg: DataFrame | None = None) -> DataFrame:
    """H6: vendor / organization aggregate (of the fact, where it is not given) with slug
    ids (sorted by name)."""
    agg = marts.group_amount_and_count(fact, [column]) if agg is None else agg
    labelled = agg.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("label"), "total_amount", "payments_count")
    return attach_slugs(labelled, [("label", "id")]).select("id", "label", "total_amount", "payments_count")


def expense_subject(contract: Column, article: Column) -> Column:
    """H13: 'contract / article' when both exist and differ ignoring case."""
    c = ustrip(F.coalesce(contract, F.lit("")))
    a = ustrip(F.coalesce(article, F.lit("")))
    both = (c != "") & (a != "") & (F.lower(c) != F.lower(a))
    return F.when(both, F.concat(c, F.lit(" / "), a)).when(c != "", c).otherwise(a)


def detail_rows(fact: DataFrame) -> DataFrame:
    """H7: one row per fact row with ids, labels, slugs and formatted date.

    ``has_transformations`` is the fact's own column when it was built next to
    the raw rows; otherwise false, as in the reference without interim files."""
    flag = F.col(HAS_TRANSFORMATIONS) if HAS_TRANSFORMATIONS in fact.columns else F.lit(False)
    base = fact.select(
        F.concat(F.lit("row_"), F.col(ROW_SEQ).cast("string")).alias("detail_row_id"),
        ROW_SEQ,
        F.col("payment_id").cast("string").alias("payment_id"),
        iso_date_text(F.col("period_date")).alias("period_date"),
        F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"),
        F.col("quarter").cast("int").alias("quarter"),
        F.col("amount").cast("double").alias("amount"),
        "status_group", "article_name", "article_code", "contract_name",
        expense_subject(F.col("contract_name"), F.col("article_name")).alias("expense_subject"),
        F.col("vendor_name").alias("vendor_label"),
        F.col("organization_name").alias("organization_label"),
        "project_name", "department_name",
        F.col("l1_category").alias("l1_category_label"),
        F.col("l2_category").alias("l2_category_label"),
        F.col("l3_category").alias("l3_category_label"),
        "classification_confidence", "matched_rule_id", "matched_keywords", "matched_vendor_pattern",
        "matched_article_pattern", "classification_reason_human", flag.alias(HAS_TRANSFORMATIONS),
    )
    slugged = attach_label_slugs(
        base,
        [
            ("vendor_label", "vendor_id"),
            ("organization_label", "organization_id"),
            ("l1_category_label", "l1_category_id"),
            ("l2_category_label", "l2_category_id"),
            ("l3_category_label", "l3_category_id"),
        ],
    )
    return slugged.select(*DETAIL_COLUMNS)


DETAIL_COLUMNS = [
    "detail_row_id", ROW_SEQ, "payment_id", "period_date", "year", "month", "quarter", "amount", "status_group",
    "article_name", "article_code", "contract_name", "expense_subject", "vendor_id", "vendor_label",
    "organization_id", "organization_label", "project_name", "department_name", "l1_category_id",
    "l1_category_label", "l2_category_id", "l2_category_label", "l3_category_id", "l3_category_label",
    "classification_confidence", "matched_rule_id", "matched_keywords", "matched_vendor_pattern",
    "matched_article_pattern", "classification_reason_human", "has_transformations",
]


def detail_row_index(details: DataFrame) -> DataFrame:
    """H8: the eight drill keys of every row, exploded: (key, detail_row_id,
    _row_seq).  The per-key id lists of the studied payload are this table
    grouped by key and ordered by ``_row_seq``; it is kept exploded because
    one key (a status, a year) can hold a third of all rows."""
    def key(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix + ":"), F.coalesce(value.cast("string"), F.lit("None")))

    keys = F.array_distinct(
        F.array(
            key("year", F.col("year")),
            key("month", F.col("month")),
            key("status", F.col("status_group")),
            key("organization", F.col("organization_id")),
            key("vendor", F.col("vendor_id")),
            key("l1", F.col("l1_category_id")),
            key("l2", F.col("l2_category_id")),
            key("l3", F.col("l3_category_id")),
        )
    )
    return details.select(F.explode(keys).alias("key"), "detail_row_id", ROW_SEQ)
