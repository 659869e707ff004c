"""Boilerplate lines by site-relative frequency (operator 6).

A line is boilerplate on its host when it stands on more than ``ratio`` of the
host's pages, and on at least ``least_pages`` of them.  Pages of one host with
the same text count as one page, so copies of a page don't make its lines
boilerplate.  Lines are compared by a
64-bit hash of their trimmed text within one host; blank lines always stay.
Only DataFrame functions run: (host, line) pairs are counted with map-side
combining, and a page's text meets only the hashes of its own dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

RATIO = 0.02
LEAST_PAGES = 5
_TRIM = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(_TRIM))


def drop_boilerplate_lines(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus n_lines and
    n_dropped (long); further columns pass through unless they clash with these.

    Every row is cut, repeated ids or not.  A NULL host is a host of its
    own.  NULL texts stay NULL with no lines; an empty text has one blank line.
    A text may end empty.  An empty table gives no rows.
    """
    pages = docs.select("doc_id", F.col(host).alias("host"), "text", F.xxhash64("text").alias("page"))
    hashes = F.transform(
        F.filter(F.transform(_lines(F.col("text")), _trimmed), lambda x: x != ""), lambda x: F.xxhash64(x)
    )
    placed = written(
        pages.select("doc_id", "host", "page", F.explode(F.array_distinct(hashes)).alias("line")), "lines"
    )
    totals = pages.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    counts = placed.groupBy("host", "line").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least_pages)
    frequent = written(
        counts.alias("c")
        .join(totals.alias("t"), F.expr("c.host <=> t.host"))
        .where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .select("c.host", "c.line"),
        "boilerplate",
    )
    drops = (
        placed.alias("p")
        .join(frequent.alias("f"), F.expr("p.host <=> f.host and p.line = f.line"), "left_semi")
        .groupBy("doc_id", "host")
        .agg(F.collect_set("line").alias("__drop"))
        .select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), "__drop")
    )
    kept = F.filter(
        _lines(F.col("text")),
        lambda x: (_trimmed(x) == "") | ~F.array_contains("__drop", F.xxhash64(_trimmed(x))),
    )
    before = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long")
    out = docs.join(drops, docs["doc_id"].eqNullSafe(F.col("__id")) & docs[host].eqNullSafe(F.col("__host")), "left")
    out = out.withColumn("__kept", F.when(F.col("__drop").isNotNull(), kept))
    return out.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(before).cast("long"),
            "n_dropped": F.coalesce(before - F.size("__kept"), F.lit(0)).cast("long"),
            "text": F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col("text")),
        }
    ).drop("__id", "__host", "__drop", "__kept")


ORACLE = f"""
WITH pages AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
lines AS (
  SELECT DISTINCT text, source, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT text, source, unnest(string_split(text, chr(10))) AS line FROM pages)
),
totals AS (SELECT source, count(DISTINCT coalesce(text, 'NULL')) AS pages FROM pages GROUP BY source),
frequent AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.line <> '' GROUP BY l.source, l.line, t.pages
  HAVING count(*) >= {LEAST_PAGES} AND count(*) > {RATIO} * t.pages
),
cut AS (
  SELECT p.rid, p.pos, p.line, f.line IS NOT NULL AS dropped
  FROM (
    SELECT rid, source, line, generate_subscripts AS pos FROM (
      SELECT rid, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS generate_subscripts FROM pages)
  ) p
  LEFT JOIN frequent f ON p.source IS NOT DISTINCT FROM f.source
    AND trim(p.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = f.line
),
joined AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text
  FROM cut GROUP BY rid
)
SELECT p.doc_id, p.source, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text,
       CAST(coalesce(j.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(j.n_dropped, 0) AS BIGINT) AS n_dropped
FROM pages p LEFT JOIN joined j USING (rid)
"""
