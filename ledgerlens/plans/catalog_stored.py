"""Registered queries of tables that are written and read back: exports, sinks, the
detail store, published versions and loads in steps.  Each derives what it writes
from the given tables and returns what a reader of the written files sees."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import config as cfg
from ledgerlens import oracle as O
from ledgerlens.operators import classify as D
from ledgerlens.operators import dashboard as H
from ledgerlens.operators import detail_store as S
from ledgerlens.operators import drill as I
from ledgerlens.operators import marts as E
from ledgerlens.plans import stages
from ledgerlens.plans.catalog import (
    DET_LIGHT, DRILL_YEAR, PLAIN_DETAILS_SQL, REVIEW_SQL, TREE_SQL, YEARS, register,
)
from ledgerlens.plans.pipeline import load_years, run_pipeline
from ledgerlens.plans.publish import read_published
from ledgerlens.session import shared_dir, written
from ledgerlens.sources import csv_source, ingest, sinks
from ledgerlens.sources.adapter import RAW_COLUMNS
from ledgerlens.sources.ingest import ROW_SEQ


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _export(df: DataFrame, path: str, delimiter: str) -> None:
    writer = df.write.option("header", True).option("sep", delimiter).option("escape", csv_source.QUOTE)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _document_exports(spark: SparkSession, sf_dir: str) -> str:
    """The documents as delimited files, a quarter under each delimiter; their texts hold
    line feeds, delimiters and quotes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    path = _new_folder(spark, "exports")
    for i, delimiter in enumerate(csv_source.CANDIDATE_DELIMITERS):
        _export(docs.where(F.pmod("doc_id", F.lit(4)) == i), f"{path}/{i}", delimiter)
    return f"{path}/*"


@register(
    "csv_scan",
    "SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM documents",
)
def q_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3: delimited files of four delimiters, with records that span lines, read back."""
    back = csv_source.read_payments_csv(spark, _document_exports(spark, sf_dir))
    return back.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.length("text").cast("long").alias("n_chars"),
        F.md5("text").alias("text_md5"),
    )


@register(
    "delimiter_vote",
    "SELECT CASE doc_id % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN '|' ELSE chr(9) END AS delimiter, 'UTF-8' AS encoding, "
    "bool_or(contains(text, chr(10))) AS multiline FROM documents GROUP BY doc_id % 4",
)
def q_delimiter_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    formats = csv_source.file_formats(spark, _document_exports(spark, sf_dir))
    return formats.groupBy("delimiter", "encoding").agg(F.bool_or("multiline").alias("multiline"))


@register("ingest_exports", "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in RAW_COLUMNS) + " FROM raw")
def q_ingest_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + B1 + B2: the raw payments written as an export under spoken headings, read,
    renamed, checked and numbered."""
    path = _new_folder(spark, "payments")
    raw = stages.ingested(spark, sf_dir, numbered=False).select(*RAW_COLUMNS)
    _export(raw.toDF(*[f" {c.replace('_', ' ').capitalize()}:" for c in RAW_COLUMNS]), path, ";")
    return ingest.ingest_exports(spark, path).drop(ROW_SEQ)


_REVIEWED = [c.split()[0] for c in csv_source.REVIEW_CSV_SCHEMA.split(", ")]


@register("reviewed_csv_scan", "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _REVIEWED) + f" FROM ({REVIEW_SQL})")
def q_reviewed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + A10: the review queue written for analysts and read back."""
    queue = D.build_review_queue(stages.classified(spark, sf_dir)).drop(ROW_SEQ)
    back = csv_source.read_reviewed_csv(spark, sinks.write_review_csv(queue, _new_folder(spark, "queue")))
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _REVIEWED])


@register("json_sink", f"SELECT status_group, {O.AMOUNT_AND_COUNT} FROM fact GROUP BY status_group")
def q_json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report section as JSON lines, read back."""
    section = E.build_agg_status(stages.unclassified_fact(spark, sf_dir))
    return spark.read.schema(section.schema).json(sinks.write_json(section, _new_folder(spark, "section")))


@register(
    "required_columns",
    "SELECT unnest(['period', 'summa']) AS missing, count(*) AS n_rows FROM raw",
)
def q_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: what an export without two of its columns lacks, with its rows."""
    raw = stages.ingested(spark, sf_dir, numbered=False).drop("summa", "period")
    missing = sorted(ingest.missing_required_columns(raw, RAW_COLUMNS))
    return raw.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array(*map(F.lit, missing))).alias("missing"), "n_rows")


# ---------------------------------------------------------------- detail store

_KEYS_SQL = (
    "SELECT DISTINCT unnest([" + ", ".join(f"'{p}:' || coalesce(CAST({c} AS VARCHAR), 'None')" for p, c in S.DRILL_KEYS.items())
    + f"]) AS key, _row_seq FROM ({PLAIN_DETAILS_SQL})"
)


@register(
    "detail_posting_lists",
    f"SELECT key, _row_seq // {S.CHUNK_ROWS} AS chunk, CAST(count(*) AS INTEGER) AS n, "
    f"string_agg(CAST(_row_seq AS VARCHAR), ',' ORDER BY _row_seq) AS rows FROM ({_KEYS_SQL}) GROUP BY ALL",
)
def q_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: ordered row numbers of every drill key, by chunk."""
    lists = S.drill_index(H.detail_rows(stages.written_fact(spark, sf_dir)))
    numbers = F.transform(S.offsets(F.col("runs")), lambda o: F.col("chunk") * S.CHUNK_ROWS + o)
    return lists.select("key", "chunk", "n", F.array_join(numbers, ",").alias("rows"))


def _store(spark: SparkSession, sf_dir: str, text: bool) -> str:
    path = S.write_details(H.detail_rows(stages.written_fact(spark, sf_dir)), _new_folder(spark, "details"))
    return S.write_index(S.read_details(spark, path), path, text)


@register(
    "detail_filter_indexed",
    f"SELECT detail_row_id, amount, vendor_id FROM {DET_LIGHT} WHERE year = {DRILL_YEAR} AND month IN (1, 2, 3) "
    "AND status_group IN ('paid', 'in_approval') AND l1_category_id = 'infrastructure' AND classification_confidence <> 'low'",
)
def q_filter_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five predicates answered by intersecting posting lists."""
    found = S.find_details(
        spark, _store(spark, sf_dir, text=False), year=DRILL_YEAR, month=[1, 2, 3], status_group=["paid", "in_approval"],
        l1_category_id="infrastructure", classification_confidence=["high", "medium", "unclassified"],
    )
    return found.select("detail_row_id", "amount", "vendor_id")


@register(
    "detail_search_indexed",
    f"SELECT detail_row_id, amount FROM {DET_LIGHT} WHERE status_group = 'paid' AND contains(lower(concat_ws(' ', "
    + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in O.SEARCHED) + ")), 'kaspersky')",
)
def q_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 + I2: a predicate and a text, by posting lists and trigrams."""
    found = S.find_details(spark, _store(spark, sf_dir, text=True), "Kaspersky", status_group="paid")
    return found.select("detail_row_id", "amount")


PAGE = 123


def _page_order(key: str) -> str:
    return "amount DESC NULLS LAST" if key == "amount" else f"coalesce(CAST({key} AS VARCHAR), '') COLLATE ru"


@register(
    "detail_pages",
    f"SELECT sort_key, position, detail_row_id FROM (WITH d AS MATERIALIZED (SELECT * FROM {DET_LIGHT}) " + " UNION ALL ".join(
        f"SELECT '{key}' AS sort_key, row_number() OVER (ORDER BY {_page_order(key)}, _row_seq) - 1 AS position, detail_row_id FROM d"
        for key in I.SORT_FIELDS
    ) + f") WHERE position >= {(PAGE - 1) * cfg.DETAIL_PAGE_SIZE} AND position < {PAGE * cfg.DETAIL_PAGE_SIZE}",
)
def q_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3 + I4: one deep page under each sort key, Russian order for texts, from page directories."""
    path = S.write_details(H.detail_rows(stages.written_fact(spark, sf_dir)), _new_folder(spark, "details"))
    details = S.read_details(spark, path)
    pages = [
        S.read_page(spark, path, S.write_pages(details, path, key), PAGE).select(F.lit(key).alias("sort_key"), "position", "detail_row_id")
        for key in I.SORT_FIELDS
    ]
    return reduce(DataFrame.union, pages)


# ---------------------------------------------------------------- marts in steps

_TYPES = {"year": "INTEGER", "month": "INTEGER"}


@register(
    "aggregate_cube",
    " UNION ALL ".join(
        f"SELECT '{name}' AS grouping, "
        + ", ".join(c if c in dims else f"CAST(NULL AS {_TYPES.get(c, 'VARCHAR')}) AS {c}" for c in E.CUBE_COLUMNS)
        + f", {O.AMOUNT_AND_COUNT} FROM fact GROUP BY {', '.join(dims)}"
        for name, dims in E.CUBE_SETS.items()
    ),
)
def q_aggregate_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8-E15 and the levels of H4 from one scan."""
    return E.aggregate_cube(stages.plain_fact(spark, sf_dir))


@register(
    "dimension_in_two_loads",
    "SELECT CAST(row_number() OVER (ORDER BY first_seen) AS BIGINT) AS vendor_id, vendor_name FROM "
    "(SELECT vendor_name, min(_row_seq) AS first_seen FROM fact GROUP BY vendor_name)",
)
def q_dimension_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendors of a first load, kept and extended by a second one."""
    fact = written(stages.fact(spark, sf_dir).select("vendor_name", ROW_SEQ), "fact")
    half = fact.agg(F.max(ROW_SEQ) / 50).first()[0] or 0  # so early that the second load has new members
    first = written(E.build_dimension(fact.where(F.col(ROW_SEQ) < half), "dim_vendors"), "dimension")
    return E.build_dimension(fact.where(F.col(ROW_SEQ) >= half), "dim_vendors", first)


def _rows_sql(name: str, table: str) -> str:
    return f"SELECT '{name}' AS name, count(*) AS n_rows FROM ({table})"


_MARTS_SQL = [
    _rows_sql("fact", "SELECT 1 FROM fact"), _rows_sql("classified", "SELECT 1 FROM classified"),
    _rows_sql("review_queue", REVIEW_SQL), _rows_sql("categories_tree", TREE_SQL),
    _rows_sql("detail_row_index", _KEYS_SQL), _rows_sql("detail_rows", "SELECT 1 FROM fact"), _rows_sql("detail_row_details", "SELECT 1 FROM fact"),
    *[_rows_sql(name, f"SELECT DISTINCT {', '.join(columns)} FROM fact") for name, (columns, _) in E.DIMENSIONS.items()],
    *[_rows_sql(name, f"SELECT DISTINCT {', '.join(E.CUBE_SETS[name])} FROM fact") for name in E.RECONCILED],
    _rows_sql("management_insights", "SELECT unnest(range(5))"), _rows_sql("qa_report", "SELECT unnest(range(5))"),
    _rows_sql("kpis", "SELECT unnest(range(5))"), _rows_sql("metadata", "SELECT 1"),
]


@register("published_tables", " UNION ALL ".join(_MARTS_SQL))
def q_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run, published; the rows of its tables as a reader sees them."""
    out = _new_folder(spark, "published")
    run_pipeline(spark, stages.ingested(spark, sf_dir, numbered=False), out, years=YEARS, order_cols=RAW_COLUMNS)
    names = [sql.split("'")[1] for sql in _MARTS_SQL]
    counts = [read_published(spark, out, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows")) for name in names]
    return reduce(DataFrame.union, counts)


@register("yearly_loads", f"SELECT year, {O.AMOUNT_AND_COUNT} FROM fact GROUP BY year")
def q_yearly_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a load of all years and one that brings a year again; the years of the published fact."""
    out = _new_folder(spark, "loads")
    raw = written(stages.ingested(spark, sf_dir, numbered=False), "raw")  # each load samples and sorts it
    load_years(spark, raw, out, years=YEARS, order_cols=RAW_COLUMNS)
    load_years(spark, raw.where(F.contains("period", F.lit(str(DRILL_YEAR)))), out, years=YEARS, order_cols=RAW_COLUMNS)
    return E.group_amount_and_count(read_published(spark, out, "fact"), ["year"])
