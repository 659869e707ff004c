"""Stand-in input: the driver's TPC-H-like tables shaped as a raw payments export.

The test tables hold no payments, so one SQL text (using only functions that
Spark SQL and DuckDB both understand) turns every lineitem into one raw export
row of strings, in the 15-column contract plus ``naznachenie_platezha``.  It
only produces rows in the schema the jobs expect: amounts become locale
strings, dates become ISO or day-first text, statuses become Russian registry
labels.  No cleaning, classification or aggregation happens here; the jobs do
that work on whatever strings arrive.

Years in this data are 1995-2001, so the reporting-year parameters used with it
are ``ADAPTER_YEARS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_TABLES = ["lineitem", "orders", "customer", "part", "supplier", "nation"]
ADAPTER_YEARS = (1999, 2000)

RAW_COLUMNS = [
    "quarter_period",
    "report_type",
    "quarter_str",
    "year_month_str",
    "year_num",
    "registrator_status_name",
    "bit_stati_oborotov_naimenovanie",
    "bit_stati_oborotov_kodifikator",
    "summa",
    "period",
    "kontragenti_naimenovanie",
    "dogovori_kontragentov_naimenovanie",
    "proekti_naimenovanie",
    "podrazdeleniya_naimenovanie",
    "organizacii_naimenovanie",
    "naznachenie_platezha",
]

NBSP = " "

# Inner query: base values per lineitem; outer query: formatting variants.
ADAPTER_SQL = """
SELECT
  concat(y, 'Q', q) AS quarter_period,
  'fact' AS report_type,
  concat('Q', q, ' ', y) AS quarter_str,
  substr(d, 1, 7) AS year_month_str,
  y AS year_num,
  CASE
    WHEN ln = 7 THEN 'Неизвестно'
    WHEN rf = 'R' AND ls = 'O' THEN 'Отклонен'
    WHEN os = 'F' AND ln = 4 THEN 'не оплачен'
    WHEN os = 'F' THEN 'Оплачен полностью'
    WHEN os = 'O' AND ln = 3 THEN '  УТВЕРЖДЕН '
    WHEN os = 'O' THEN 'Утвержден'
    ELSE 'На согласовании'
  END AS registrator_status_name,
  CASE
    WHEN art IS NULL THEN NULL
    WHEN ln = 3 THEN concat('  ', upper(art), '  ')
    WHEN ln = 5 THEN replace(art, ' ', '  ')
    ELSE art
  END AS bit_stati_oborotov_naimenovanie,
  brand AS bit_stati_oborotov_kodifikator,
  CASE
    WHEN ln = 6 AND qty < 3 THEN 'n/a'
    WHEN ln = 6 AND rf = 'R' THEN concat('-', replace(amt, '.', ','))
    WHEN ln = 1 THEN amt
    WHEN ln = 3 AND length(amt) > 6 THEN concat(
      substr(replace(amt, '.', ','), 1, length(amt) - 6), ' ', substr(replace(amt, '.', ','), length(amt) - 5))
    WHEN ln = 5 AND length(amt) > 6 THEN concat(
      substr(replace(amt, '.', ','), 1, length(amt) - 6), '{nbsp}', substr(replace(amt, '.', ','), length(amt) - 5))
    ELSE replace(amt, '.', ',')
  END AS summa,
  CASE
    WHEN ln = 7 AND qty > 48 THEN NULL
    WHEN ln = 2 THEN concat(substr(d, 9, 2), '.', substr(d, 6, 2), '.', substr(d, 1, 4))
    WHEN ln = 4 THEN concat(d, ' 00:00:00')
    ELSE d
  END AS period,
  CASE suppkey % 10
    WHEN 1 THEN concat(sname, ' Kaspersky Lab')
    WHEN 2 THEN concat(sname, ' Selectel')
    WHEN 3 THEN concat(sname, ' MTS')
    WHEN 4 THEN concat('ООО Контур ', sname)
    WHEN 5 THEN concat('  ', upper(sname), ' ')
    ELSE sname
  END AS kontragenti_naimenovanie,
  CASE prio
    WHEN '1-URGENT' THEN concat(prio, ' license')
    WHEN '2-HIGH' THEN concat(prio, ' subscription')
    WHEN '3-MEDIUM' THEN concat(prio, ' support contract')
    ELSE prio
  END AS dogovori_kontragentov_naimenovanie,
  pname AS proekti_naimenovanie,
  segment AS podrazdeleniya_naimenovanie,
  nname AS organizacii_naimenovanie,
  CASE WHEN ln = 4 THEN concat(pname, ' implementation support') ELSE pname END AS naznachenie_platezha
FROM (
  SELECT
    cast(year(l.l_shipdate) AS string) AS y,
    cast(quarter(l.l_shipdate) AS string) AS q,
    cast(cast(l.l_shipdate AS date) AS string) AS d,
    cast(cast(l.l_extendedprice AS decimal(18,2)) AS string) AS amt,
    l.l_linenumber AS ln,
    l.l_quantity AS qty,
    l.l_returnflag AS rf,
    l.l_linestatus AS ls,
    o.o_orderstatus AS os,
    o.o_orderpriority AS prio,
    CASE
      WHEN p.p_size % 10 = 9 AND l.l_linenumber = 6 THEN NULL
      WHEN p.p_size % 10 = 0 THEN 'Оплата хостингов и доменов'
      WHEN p.p_size % 10 = 1 THEN 'Картриджи и запасные части для МФУ и принтеров'
      WHEN p.p_size % 10 = 2 THEN 'Программное обеспечение'
      WHEN p.p_type = 'STANDARD' THEN 'hosting services'
      WHEN p.p_type = 'ECONOMY' THEN 'Microsoft 365'
      WHEN p.p_type = 'MEDIUM' THEN 'Laptop purchase'
      WHEN p.p_type = 'PROMO' THEN 'security subscription'
      WHEN p.p_type = 'LARGE' THEN 'Мобильная связь'
      ELSE 'misc payment'
    END AS art,
    p.p_brand AS brand,
    p.p_name AS pname,
    s.s_suppkey AS suppkey,
    s.s_name AS sname,
    c.c_mktsegment AS segment,
    n.n_name AS nname
  FROM {lineitem} l
  JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  JOIN {customer} c ON o.o_custkey = c.c_custkey
  JOIN {part} p ON l.l_partkey = p.p_partkey
  JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  JOIN {nation} n ON c.c_nationkey = n.n_nationkey
) base
"""


def adapter_sql(table_names: dict[str, str] | None = None) -> str:
    names = {t: t for t in SOURCE_TABLES}
    names.update(table_names or {})
    return ADAPTER_SQL.replace("{nbsp}", NBSP).format(**names)


def load_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}


#: Payments that a task makes, where there are more than a core has tasks for.
MOST_ROWS = 400_000


def payments_expected(spark: SparkSession, sf_dir: str) -> int:
    """About how many payments the tables make: their lineitems, counted from the files' footers."""
    return load_tables(spark, sf_dir, ["lineitem"])["lineitem"].count()


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw export rows (all strings) built from the driver's tables.

    Orders are always joined by a shuffle: broadcast, a lineitem file of few row
    groups would be cleaned and classified in as few tasks.  Where a task a core would
    make more than MOST_ROWS payments, the partitions follow the lineitems, counted from
    their files' footers: sized by the bytes of the narrow lineitems, tasks would be one
    a core and one that the others wait for, and each would hold rows of many times
    that size once they are payments."""
    tables = load_tables(spark, sf_dir, SOURCE_TABLES)
    rows, cores = tables["lineitem"].count(), spark.sparkContext.defaultParallelism
    if rows > MOST_ROWS * cores:
        tasks = max(3 * cores, -(-rows // MOST_ROWS))
        tables["lineitem"] = tables["lineitem"].repartition(tasks, "l_orderkey")
        tables["orders"] = tables["orders"].repartition(tasks, "o_orderkey")
    tables["orders"] = tables["orders"].hint("merge")
    text = ADAPTER_SQL.replace("{nbsp}", NBSP)
    text = text.replace("{lineitem}", "{t_lineitem}").replace("{orders}", "{t_orders}")
    text = text.replace("{customer}", "{t_customer}").replace("{part}", "{t_part}")
    text = text.replace("{supplier}", "{t_supplier}").replace("{nation}", "{t_nation}")
    return spark.sql(text, **{f"t_{k}": v for k, v in tables.items()})
