"""Payments fact, dimensions and aggregates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import config as cfg
from ledgerlens.functions.amounts import NUMBER_PATTERN, amount_parts, exact_sum, merged_parts, parts_total
from ledgerlens.functions.dates import as_timestamp
from ledgerlens.functions.ids import payment_id, stable_key_text, with_dense_index
from ledgerlens.session import written
from ledgerlens.sources.ingest import ROW_SEQ

HAS_TRANSFORMATIONS = "has_transformations"
#: The fact's columns that the classifier fills.
CLASSIFIED_COLUMNS = [
    "l1_category", "l2_category", "l3_category", "classification_confidence", "matched_rule_id", "matched_keywords",
    "matched_vendor_pattern", "matched_article_pattern", "classification_reason_human",
]
_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def _dtype(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def _string_or_default(df: DataFrame, column: str, default: str = "") -> Column:
    """Existing column -> string, NULL -> default; absent -> default."""
    if column in df.columns:
        return F.coalesce(F.col(column).cast("string"), F.lit(default))
    return F.lit(default)


def _prefer_column(df: DataFrame, column: str, fallback: Column) -> Column:
    """Existing year/month/quarter column (non-numeric -> NULL), else fallback."""
    if column in df.columns:
        return F.col(column).cast("string").try_cast("double").try_cast("int")
    return fallback.cast("int")


def payment_id_column(df: DataFrame) -> Column:
    """md5 over the eight stripped key values joined by '|'."""
    parts = []
    for column in cfg.PAYMENT_ID_COLUMNS:
        if column not in df.columns:
            parts.append(F.lit(""))
            continue
        dtype = _dtype(df, column)
        if dtype.startswith("timestamp") or dtype == "date":
            parts.append(stable_key_text(F.col(column), "timestamp"))
        elif dtype in _NUMERIC or dtype.startswith("decimal"):
            parts.append(stable_key_text(F.col(column), "amount"))
        else:
            parts.append(stable_key_text(F.col(column), "string"))
    return payment_id(parts)


def build_payments_fact(df: DataFrame) -> DataFrame:
    """One row per payment line, 24 ordered columns (+ ``_row_seq`` when present)."""
    period_date = (
        as_timestamp(F.col("period"), _dtype(df, "period")) if "period" in df.columns else F.lit(None).cast("timestamp")
    )
    if "summa" in df.columns:
        if _dtype(df, "summa") in _NUMERIC or _dtype(df, "summa").startswith("decimal"):
            amount = F.col("summa").cast("double")
        else:
            text = F.col("summa").cast("string")
            amount = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    else:
        amount = F.lit(None).cast("double")
    cols = {
        "payment_id": payment_id_column(df),
        "period_date": period_date,
        "year": _prefer_column(df, "year", F.year(period_date)),
        "month": _prefer_column(df, "month", F.month(period_date)),
        "quarter": _prefer_column(df, "quarter", F.quarter(period_date)),
        "amount": F.coalesce(amount, F.lit(0.0)),
        "status_raw": _string_or_default(df, "registrator_status_name"),
        "status_group": _string_or_default(df, "business_status"),
        "article_name": _string_or_default(df, "bit_stati_oborotov_naimenovanie"),
        "article_code": _string_or_default(df, "bit_stati_oborotov_kodifikator"),
        "vendor_name": _string_or_default(df, "kontragenti_naimenovanie"),
        "contract_name": _string_or_default(df, "dogovori_kontragentov_naimenovanie"),
        "project_name": _string_or_default(df, "proekti_naimenovanie"),
        "department_name": _string_or_default(df, "podrazdeleniya_naimenovanie"),
        "organization_name": _string_or_default(df, "organizacii_naimenovanie"),
        "l1_category": _string_or_default(df, "l1_category", cfg.FACT_DEFAULT_L1),
        "l2_category": _string_or_default(df, "l2_category", cfg.FACT_DEFAULT_L2),
        "l3_category": _string_or_default(df, "l3_category", cfg.FACT_DEFAULT_L3),
        "classification_confidence": _string_or_default(df, "classification_confidence", cfg.FACT_DEFAULT_CONFIDENCE),
        "matched_rule_id": _string_or_default(df, "matched_rule_id"),
        "matched_keywords": _string_or_default(df, "matched_keywords"),
        "matched_vendor_pattern": _string_or_default(df, "matched_vendor_pattern"),
        "matched_article_pattern": _string_or_default(df, "matched_article_pattern"),
        "classification_reason_human": _string_or_default(df, "classification_reason_human"),
    }
    selected = [cols[name].alias(name) for name in cfg.FACT_COLUMNS]
    selected += [F.col(c) for c in (ROW_SEQ, HAS_TRANSFORMATIONS) if c in df.columns]
    return df.select(*selected)


# --------------------------------------------------------------------------
# dimensions
# --------------------------------------------------------------------------

DIMENSIONS = {
    "dim_vendors": (["vendor_name"], "vendor_id"),
    "dim_articles": (["article_code", "article_name"], "article_id"),
    "dim_orgs": (["organization_name"], "organization_id"),
    "dim_projects": (["project_name"], "project_id"),
}


def _unique_dimension(fact: DataFrame, columns: list[str], key_name: str, stored: DataFrame | None = None) -> DataFrame:
    """Distinct members numbered 1..n in first-seen order (NULL is a member).

    First-seen = smallest ``_row_seq``; numbering uses the distributed dense
    index over the *distinct* members, never a window over the fact.  With a
    ``stored`` dimension its members keep their numbers, and those it lacks are
    numbered after its greatest one: loads that only append end with the same
    table as one load of all.
    """
    if ROW_SEQ in fact.columns:
        members = fact.groupBy(*columns).agg(F.min(ROW_SEQ).alias("__first"))
        order = [F.col("__first").asc()]
    else:
        members = fact.select(*columns).distinct().withColumn("__first", F.lit(0))
        order = [F.col(c).asc_nulls_first() for c in columns]
    start = 1
    if stored is not None:
        start += stored.agg(F.coalesce(F.max(key_name), F.lit(0))).first()[0]
        known = stored.select(*[F.col(c).alias(f"__known_{c}") for c in columns])
        same = [F.col(c).eqNullSafe(F.col(f"__known_{c}")) for c in columns]
        members = members.join(known, reduce(lambda a, b: a & b, same), "left_anti")
    numbered = with_dense_index(members, key_name, order, start=start)
    numbered = numbered.select(F.col(key_name).cast("long").alias(key_name), *columns)
    return numbered if stored is None else stored.select(*numbered.columns).union(numbered)


def build_dimension(fact: DataFrame, name: str, stored: DataFrame | None = None) -> DataFrame:
    """E4-E7 by table name, from the start or maintained from the ``stored`` one."""
    columns, key_name = DIMENSIONS[name]
    return _unique_dimension(fact, columns, key_name, stored)


def build_dim_vendors(fact: DataFrame) -> DataFrame:
    return build_dimension(fact, "dim_vendors")


def build_dim_articles(fact: DataFrame) -> DataFrame:
    return build_dimension(fact, "dim_articles")


def build_dim_orgs(fact: DataFrame) -> DataFrame:
    return build_dimension(fact, "dim_orgs")


def build_dim_projects(fact: DataFrame) -> DataFrame:
    return build_dimension(fact, "dim_projects")


def build_dimensions(fact: DataFrame, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    return {name: build_dimension(fact, name, (stored or {}).get(name)) for name in DIMENSIONS}


# --------------------------------------------------------------------------
# aggregates
# --------------------------------------------------------------------------

def amount_and_count() -> list[Column]:
    """E15 metrics: exact (decimal) sum of amount, distinct payment ids.

    ``countDistinct`` plans as a two-phase aggregate keyed first by
    (group, payment_id) with map-side dedup, so a hot group or a heavily
    duplicated payment never lands whole in one task.
    """
    return [
        exact_sum(F.col("amount")).alias("total_amount"),
        F.countDistinct("payment_id").alias("payments_count"),
    ]


def group_amount_and_count(fact: DataFrame, dims: list[str]) -> DataFrame:
    grouped = fact.groupBy(*dims).agg(*amount_and_count())
    return grouped.orderBy(*[F.col(d).asc_nulls_last() for d in dims])


def year_month_label() -> Column:
    return F.concat(F.col("year").cast("string"), F.lit("-"), F.lpad(F.col("month").cast("string"), 2, "0"))


def build_agg_kpi_year_month(fact: DataFrame) -> DataFrame:
    """By (year, month) + 'YYYY-MM' label."""
    grouped = fact.groupBy("year", "month").agg(*amount_and_count())
    return grouped.select("year", "month", year_month_label().alias("year_month"), "total_amount", "payments_count").orderBy(
        F.col("year").asc_nulls_last(), F.col("month").asc_nulls_last()
    )


def build_agg_status(fact: DataFrame) -> DataFrame:
    return group_amount_and_count(fact, ["status_group"])


def build_agg_categories(fact: DataFrame) -> DataFrame:
    return group_amount_and_count(fact, ["l1_category", "l2_category", "l3_category"])


def build_agg_vendors(fact: DataFrame) -> DataFrame:
    return group_amount_and_count(fact, ["vendor_name"])


def build_agg_orgs(fact: DataFrame) -> DataFrame:
    return group_amount_and_count(fact, ["organization_name"])


def build_agg_department(fact: DataFrame) -> DataFrame:
    return group_amount_and_count(fact, ["department_name"])


def build_agg_year_compare(fact: DataFrame, years: tuple[int, ...] = cfg.DEFAULT_REPORTING_YEARS) -> DataFrame:
    """Yearly totals for the compared years (pushed-down ``year IN (...)``)."""
    filtered = fact.where(F.col("year").isin(*[int(y) for y in years]))
    return group_amount_and_count(filtered, ["year"])


#: Columns of the cube, and the groupings it holds by name (E8-E14 and the levels of the tree).
CUBE_COLUMNS = [
    "year", "month", "status_group", "l1_category", "l2_category", "l3_category", "vendor_name", "organization_name", "department_name",
]
CUBE_SETS = {
    "agg_kpi_year_month": ["year", "month"],
    "agg_status": ["status_group"],
    "agg_categories": ["l1_category", "l2_category", "l3_category"],
    "agg_vendors": ["vendor_name"],
    "agg_orgs": ["organization_name"],
    "agg_department": ["department_name"],
    "agg_year": ["year"],
    "tree_l1": ["l1_category"],
    "tree_l2": ["l1_category", "l2_category"],
}


def aggregate_cube(fact: DataFrame, names: Iterable[str] = tuple(CUBE_SETS)) -> DataFrame:
    """(grouping, columns, total_amount, payments_count) of the named groupings of
    CUBE_SETS, columns outside a grouping NULL, from one scan of the fact.

    Rows of equal payment and columns are summed first (map-side), so a payment
    repeated in a third of the rows is one row.  What is left is dealt by payment id:
    then every grouping's payments are distinct within a partition, and the counts
    of partitions add up.  The groupings are unfolded after that exchange, so ids
    are not shuffled once per grouping.
    """
    sets = {name: CUBE_SETS[name] for name in names}
    columns = [c for c in CUBE_COLUMNS if any(c in dims for dims in sets.values())]
    cells = fact.groupBy("payment_id", *columns).agg(*amount_parts(F.col("amount"))).repartition("payment_id")
    rows = [
        F.struct(
            F.lit(name).alias("grouping"),
            *[(F.col(c) if c in dims else F.lit(None).cast(fact.schema[c].dataType)).alias(c) for c in columns],
        )
        for name, dims in sets.items()
    ]
    measures = [c for c in cells.columns if c not in columns]
    unfolded = cells.select(*measures, F.inline(F.array(*rows)))
    payments = unfolded.groupBy("grouping", *columns, "payment_id").agg(*merged_parts())
    merged = payments.groupBy("grouping", *columns).agg(*merged_parts(), F.count("payment_id").alias("payments_count"))
    return merged.select("grouping", *columns, parts_total().alias("total_amount"), "payments_count")


def cube_grouping(cube: DataFrame, name: str) -> DataFrame:
    """One grouping of a cube, ordered by its columns."""
    dims = CUBE_SETS[name]
    own = cube.where(F.col("grouping") == name).select(*dims, "total_amount", "payments_count")
    return own.orderBy(*[F.col(d).asc_nulls_last() for d in dims])


def written_cube(fact: DataFrame) -> DataFrame:
    return written(aggregate_cube(fact), "cube")


def build_aggregations(
    fact: DataFrame, years: tuple[int, ...] = cfg.DEFAULT_REPORTING_YEARS, cube: DataFrame | None = None
) -> dict[str, DataFrame]:
    """E8-E14 by table name, all from one written cube (of the fact, where none is given)."""
    cube = written_cube(fact) if cube is None else cube
    out = {name: cube_grouping(cube, name) for name in RECONCILED}
    monthly = out["agg_kpi_year_month"]
    out["agg_kpi_year_month"] = monthly.select("year", "month", year_month_label().alias("year_month"), "total_amount", "payments_count")
    compared = cube_grouping(cube, "agg_year").where(F.col("year").isin(*[int(y) for y in years]))
    return out | {year_compare_name(years): compared}


def year_compare_name(years: tuple[int, ...]) -> str:
    return f"agg_year_compare_{'_'.join(str(y) for y in years)}"


def reconcile_totals(fact: DataFrame, aggregates: dict[str, DataFrame] | None = None) -> DataFrame:
    """Every aggregate's grand total against the fact total.

    Each aggregate partitions the same rows, so its ``total_amount`` column
    must add up to the fact total.  ``aggregates`` are the stored tables by
    name; one that is not given is computed from the fact.  Result:
    (aggregate, total_amount, fact_total, reconciled), equal to half a cent.
    """
    if set(RECONCILED) - set(aggregates or {}):  # several groupings of the fact: its rows are made once
        columns = dict.fromkeys(c for dims in RECONCILED.values() for c in dims)
        fact = written(fact.select(*columns, "amount"), "reconciled")
    parts = []
    for name, dims in RECONCILED.items():
        stored = (aggregates or {}).get(name)
        if stored is None:
            stored = fact.groupBy(*dims).agg(exact_sum(F.col("amount")).alias("total_amount"))
        total = exact_sum(F.col("total_amount")).alias("total_amount")
        parts.append(stored.agg(total).select(F.lit(name).alias("aggregate"), "total_amount"))
    fact_total = fact.agg(exact_sum(F.col("amount")).alias("fact_total"))
    joined = reduce(DataFrame.unionByName, parts).join(F.broadcast(fact_total))  # one row
    return joined.withColumn("reconciled", F.abs(F.col("total_amount") - F.col("fact_total")) < 0.005)


RECONCILED = {
    "agg_kpi_year_month": ["year", "month"],
    "agg_status": ["status_group"],
    "agg_categories": ["l1_category", "l2_category", "l3_category"],
    "agg_vendors": ["vendor_name"],
    "agg_orgs": ["organization_name"],
    "agg_department": ["department_name"],
}
