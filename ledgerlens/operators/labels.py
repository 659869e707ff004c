"""Analyst-reviewed queue rows -> new classification rules.

DataFrame -> DataFrame: the reviewed rows (8 review columns, optional
``confidence_score``) become rule rows.  Rule id from the target labels
(lower, runs outside [0-9a-z_] -> '_', trimmed; empty -> manual_review_rule_n
with n the 1-based row number), rows without a full target and ids already
present are skipped, the first row per id wins (row order = ``_row_seq``),
and priorities continue in steps of 10 after max(existing, start - 10).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.ids import with_dense_index
from ledgerlens.functions.text import ustrip


def _clean(col: Column) -> Column:
    text = ustrip(F.coalesce(col.cast("string"), F.lit("")))
    return F.when((text != "") & (F.lower(text) != "nan"), F.lower(text)).otherwise(F.lit(""))


def labels_to_rules(
    reviewed: DataFrame,
    existing_rules: list[dict[str, Any]],
    *,
    starting_priority: int = 200,
    default_confidence: float = 0.82,
    review_required_below: float = 0.75,
    order_col: str = "_row_seq",
) -> DataFrame:
    """New rules as rows: rule_id, priority, confidence, l1, l2, l3,
    conditions array<struct<column, match_type, values array<string>>>,
    review_required_below."""
    spark = reviewed.sparkSession
    existing_ids = [str(r.get("rule_id", "")) for r in existing_rules]
    base_priority = max([int(r.get("priority", 0)) for r in existing_rules] + [starting_priority - 10]) + 10
    ordered = reviewed if order_col in reviewed.columns else with_dense_index(reviewed, order_col)
    row_no = with_dense_index(ordered, "__n", [F.col(order_col).asc()], start=1)
    l1, l2, l3 = (ustrip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("suggested_l1", "suggested_l2", "suggested_l3"))
    raw_id = F.concat_ws("_", *[F.when(p != "", F.lower(p)) for p in (l1, l2, l3)])
    rule_id = F.regexp_replace(F.regexp_replace(raw_id, "[^0-9a-z_]+", "_"), "^_+|_+$", "")
    rule_id = F.when(rule_id != "", rule_id).otherwise(F.concat(F.lit("manual_review_rule_"), F.col("__n").cast("string")))
    has_target = (l1 != "") & (l2 != "") & (l3 != "")
    conf = (
        F.col("confidence_score").cast("double") if "confidence_score" in reviewed.columns else F.lit(float(default_confidence))
    )
    cond = lambda column, value: F.when(
        value != "",
        F.struct(F.lit(column).alias("column"), F.lit("contains_any").alias("match_type"), F.array(value).alias("values")),
    )
    conditions = F.filter(
        F.array(
            cond("bit_stati_oborotov_naimenovanie", _clean(F.col("raw_article"))),
            cond("naznachenie_platezha", _clean(F.col("raw_description"))),
            cond("kontragenti_naimenovanie", _clean(F.col("raw_vendor"))),
        ),
        lambda x: x.isNotNull(),
    )
    wildcard = F.array(
        F.struct(F.lit("bit_stati_oborotov_naimenovanie").alias("column"), F.lit("contains_any").alias("match_type"),
                 F.array(F.lit("*")).alias("values"))
    )
    candidates = row_no.where(has_target).select(
        rule_id.alias("rule_id"), F.col("__n"), conf.alias("confidence"), l1.alias("l1"), l2.alias("l2"), l3.alias("l3"),
        F.when(F.size(conditions) > 0, conditions).otherwise(wildcard).alias("conditions"),
    )
    known = spark.createDataFrame([(i,) for i in existing_ids] or [("",)], "rule_id string")
    fresh = candidates.join(F.broadcast(known), "rule_id", "left_anti")
    first = fresh.groupBy("rule_id").agg(F.min_by(F.struct(*[c for c in fresh.columns if c != "rule_id"]), F.col("__n")).alias("r"))
    flat = first.select("rule_id", "r.*")
    numbered = with_dense_index(flat, "__rank", [F.col("__n").asc()])
    return numbered.select(
        "rule_id",
        (F.lit(base_priority) + F.col("__rank") * 10).cast("int").alias("priority"),
        "confidence", "l1", "l2", "l3", "conditions",
        F.lit(float(review_required_below)).alias("review_required_below"),
    )


def rules_from_frame(frame: DataFrame) -> list[dict[str, Any]]:
    """Collect generated rules (a bounded config-sized frame) back to rule dicts."""
    out = []
    for r in frame.orderBy("priority").collect():
        out.append(
            {
                "rule_id": r["rule_id"], "priority": int(r["priority"]), "confidence": float(r["confidence"]),
                "target": {"l1": r["l1"], "l2": r["l2"], "l3": r["l3"]},
                "conditions": [
                    {"column": c["column"], "match_type": c["match_type"], "values": list(c["values"])} for c in r["conditions"]
                ],
                "review_required_below": float(r["review_required_below"]),
            }
        )
    return out


