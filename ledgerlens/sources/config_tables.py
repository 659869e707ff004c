"""Configuration as tables (A9) and its validation queries.

Rules, taxonomy and statuses are small, bounded configuration; they become
DataFrames with ``createDataFrame`` and are broadcast where joined.
Validations are anti joins / group-bys over the exploded tables; ``validate``
runs them (one small action) and raises with the reference messages.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import config as cfg

RULE_SCHEMA = (
    "rule_ord int, rule_id string, priority int, confidence double, review_required_below double, "
    "l1 string, l2 string, l3 string, cond_ord int, column string, match_type string, val_ord int, pattern string, "
    "extra_keys array<string>"
)
ALLOWED_RULE_KEYS = {"rule_id", "priority", "confidence", "target", "conditions", "review_required_below"}


def status_table(spark: SparkSession, statuses: dict[str, list[str]] | None = None) -> DataFrame:
    """(ord, status, pattern) with patterns lower-cased on load."""
    statuses = cfg.STATUS_RULES if statuses is None else statuses
    rows, order = [], 0
    for status, patterns in statuses.items():
        for p in patterns:
            rows.append((order, str(status), str(p).lower()))
            order += 1
    return spark.createDataFrame(rows, "ord int, status string, pattern string")


def taxonomy_table(spark: SparkSession, taxonomy: dict[str, Any] | None = None) -> DataFrame:
    """D2 flat form: (l1, description, l2, l3); an L1 without L2 or an L2
    without L3 yields a row with NULLs (found by ``taxonomy_errors``)."""
    taxonomy = cfg.TAXONOMY if taxonomy is None else taxonomy
    rows = [(l1, node.get("description"), node.get("children") or {}) for l1, node in taxonomy.items()]
    df = spark.createDataFrame(
        [(l1, d, {k: list(v or []) for k, v in ch.items()}) for l1, d, ch in rows],
        "l1 string, description string, children map<string,array<string>>",
    )
    l2 = df.select("l1", "description", F.explode_outer("children").alias("l2", "l3s"))
    return l2.select("l1", "description", "l2", F.explode_outer("l3s").alias("l3"))


def rules_table(spark: SparkSession, rules: list[dict[str, Any]] | None = None) -> DataFrame:
    """Exploded rules: one row per (rule, condition, value); a rule without
    conditions or a condition without values keeps one row with NULLs."""
    rules = cfg.CLASSIFICATION_RULES if rules is None else rules
    rows = []
    for r_ord, rule in enumerate(rules):
        target = rule.get("target") or {}
        extra = sorted(set(rule) - ALLOWED_RULE_KEYS)
        base = (
            r_ord, str(rule.get("rule_id")), int(rule.get("priority", 0)), float(rule.get("confidence", 0.0)),
            float(rule.get("review_required_below", cfg.DEFAULT_REVIEW_REQUIRED_BELOW)),
            target.get("l1"), target.get("l2"), target.get("l3"),
        )
        conditions = rule.get("conditions") or []
        if not conditions:
            rows.append(base + (None, None, None, None, None, extra))
        for c_ord, cond in enumerate(conditions):
            values = cond.get("values") or []
            if not values:
                rows.append(base + (c_ord, cond.get("column"), cond.get("match_type"), None, None, extra))
            for v_ord, v in enumerate(values):
                rows.append(base + (c_ord, cond.get("column"), cond.get("match_type"), v_ord, str(v), extra))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rule_constraint_violations(rules_df: DataFrame) -> DataFrame:
    """(rule_id, problem) for every broken constraint."""
    spark = rules_df.sparkSession
    features = spark.createDataFrame([(c,) for c in cfg.FEATURE_COLUMNS], "column string")
    types = spark.createDataFrame([(t,) for t in cfg.SUPPORTED_MATCH_TYPES], "match_type string")
    conds = rules_df.where(F.col("cond_ord").isNotNull())
    bad_col = conds.join(F.broadcast(features), "column", "left_anti").select(
        "rule_id", F.concat(F.lit("Unsupported feature column: "), F.coalesce("column", F.lit("None"))).alias("problem")
    )
    bad_type = conds.join(F.broadcast(types), "match_type", "left_anti").select(
        "rule_id", F.concat(F.lit("Unsupported match type: "), F.coalesce("match_type", F.lit("None"))).alias("problem")
    )
    empty_values = conds.where(F.col("val_ord").isNull()).select(
        "rule_id", F.lit("Condition values must not be empty.").alias("problem")
    )
    empty_pattern = conds.where(F.col("pattern") == "").select(
        "rule_id", F.lit("Empty pattern matches every row.").alias("problem")
    )
    no_conditions = rules_df.where(F.col("cond_ord").isNull()).select(
        "rule_id", F.concat(F.lit("Rule '"), F.col("rule_id"), F.lit("' must contain at least one condition.")).alias("problem")
    )
    ranges = rules_df.where(
        (F.col("confidence") < 0) | (F.col("confidence") > 1)
        | (F.col("review_required_below") < 0) | (F.col("review_required_below") > 1)
    ).select("rule_id", F.lit("confidence / review_required_below must lie in [0, 1].").alias("problem"))
    extra = rules_df.where(F.size("extra_keys") > 0).select(
        "rule_id", F.concat(F.lit("Extra keys: "), F.array_join("extra_keys", ", ")).alias("problem")
    )
    out = bad_col
    for part in (bad_type, empty_values, empty_pattern, no_conditions, ranges, extra):
        out = out.unionByName(part)
    return out.distinct()


def taxonomy_errors(tax_df: DataFrame) -> DataFrame:
    """L1 without L2, L2 without L3 (messages as the reference)."""
    no_l2 = tax_df.where(F.col("l2").isNull()).select(
        F.concat(F.lit("L1 category '"), F.col("l1"), F.lit("' must contain at least one L2 category.")).alias("problem")
    )
    no_l3 = tax_df.where(F.col("l2").isNotNull() & F.col("l3").isNull()).select(
        F.concat(F.lit("Taxonomy node '"), F.col("l2"), F.lit("' must contain at least one L3 category.")).alias("problem")
    )
    return no_l2.unionByName(no_l3)


def rule_target_errors(rules_df: DataFrame, tax_df: DataFrame) -> DataFrame:
    """D3: duplicate ids; unknown L1 / L2 / L3 target (one message per level)."""
    rules = rules_df.select("rule_ord", "rule_id", "l1", "l2", "l3").distinct()
    dup = rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "rule_id", F.concat(F.lit("Duplicate classification rule_id: "), F.col("rule_id")).alias("problem")
    )
    l1s = tax_df.select("l1").distinct()
    l2s = tax_df.select("l1", "l2").where(F.col("l2").isNotNull()).distinct()
    l3s = tax_df.select("l1", "l2", "l3").where(F.col("l3").isNotNull()).distinct()
    bad_l1 = rules.join(F.broadcast(l1s), "l1", "left_anti")
    ok_l1 = rules.join(F.broadcast(l1s), "l1", "left_semi")
    bad_l2 = ok_l1.join(F.broadcast(l2s), ["l1", "l2"], "left_anti")
    ok_l2 = ok_l1.join(F.broadcast(l2s), ["l1", "l2"], "left_semi")
    bad_l3 = ok_l2.join(F.broadcast(l3s), ["l1", "l2", "l3"], "left_anti")
    msgs = [
        dup,
        bad_l1.select("rule_id", F.concat(F.lit("Unknown L1 category in rule target: "), F.col("l1")).alias("problem")),
        bad_l2.select("rule_id", F.concat(F.lit("Unknown L2 category '"), F.col("l2"), F.lit("' under L1 '"),
                                          F.col("l1"), F.lit("'")).alias("problem")),
        bad_l3.select("rule_id", F.concat(F.lit("Unknown L3 category '"), F.col("l3"), F.lit("' under L1 '"),
                                          F.col("l1"), F.lit("' and L2 '"), F.col("l2"), F.lit("'")).alias("problem")),
    ]
    out = msgs[0]
    for m in msgs[1:]:
        out = out.unionByName(m)
    return out


def wildcard_fallback_rules(rules_df: DataFrame) -> DataFrame:
    """Rule ids whose every condition lists only '*' (after strip/lower)."""
    per_cond = rules_df.where(F.col("cond_ord").isNotNull()).groupBy("rule_ord", "rule_id", "cond_ord").agg(
        F.bool_and(F.lower(F.trim(F.col("pattern"))) == "*").alias("only_star")
    )
    return per_cond.groupBy("rule_ord", "rule_id").agg(F.bool_and("only_star").alias("fallback")).where("fallback").select(
        "rule_id"
    )


def validate(spark: SparkSession, conf: cfg.EngineConfig = cfg.DEFAULT_CONFIG) -> None:
    """Run D1-D3; raise ValueError with the first problem found."""
    if not conf.taxonomy:
        raise ValueError("Taxonomy tree must contain at least one L1 category.")
    tax = taxonomy_table(spark, conf.taxonomy)
    rules = rules_table(spark, conf.rules)
    for frame in (taxonomy_errors(tax), rule_constraint_violations(rules).select("problem"),
                  rule_target_errors(rules, tax).select("problem")):
        first = frame.select("problem").first()
        if first is not None:
            raise ValueError(first["problem"])
