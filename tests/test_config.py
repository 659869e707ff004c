import copy

import pytest

from ledgerlens import config as cfg
from ledgerlens.operators.labels import labels_to_rules, rules_from_frame
from ledgerlens.sources import config_tables as ct


def test_shipped_config_is_valid(spark):
    ct.validate(spark)
    fallback = [r["rule_id"] for r in ct.wildcard_fallback_rules(ct.rules_table(spark)).collect()]
    assert fallback == ["fallback_other_it"]
    assert ct.taxonomy_table(spark).count() == 69


def test_unknown_l3_rejected(spark):
    rules = copy.deepcopy(cfg.CLASSIFICATION_RULES)
    rules[0]["target"]["l3"] = "missing_bucket"
    with pytest.raises(ValueError, match="Unknown L3 category"):
        ct.validate(spark, cfg.EngineConfig(rules=rules))


def test_duplicate_and_bad_column(spark):
    rules = copy.deepcopy(cfg.CLASSIFICATION_RULES) + [copy.deepcopy(cfg.CLASSIFICATION_RULES[0])]
    with pytest.raises(ValueError, match="Duplicate"):
        ct.validate(spark, cfg.EngineConfig(rules=rules))
    rules = copy.deepcopy(cfg.CLASSIFICATION_RULES)
    rules[1]["conditions"][0]["column"] = "nope"
    problems = [r["problem"] for r in ct.rule_constraint_violations(ct.rules_table(spark, rules)).collect()]
    assert "Unsupported feature column: nope" in problems


def test_labels_to_rules(spark):
    reviewed = spark.createDataFrame(
        [("VPN access", "", "Provider X", "communications", "connectivity", "vpn", "low", "r", 0),
         ("other", "", "", "communications", "connectivity", "vpn", "low", "r", 1),
         ("x", "", "", "", "", "", "low", "r", 2)],
        "raw_article string, raw_description string, raw_vendor string, suggested_l1 string, suggested_l2 string, "
        "suggested_l3 string, confidence string, reason string, _row_seq long",
    )
    out = rules_from_frame(labels_to_rules(reviewed, []))
    assert len(out) == 1
    rule = out[0]
    assert rule["rule_id"] == "communications_connectivity_vpn" and rule["priority"] == 200
    assert rule["conditions"][0] == {"column": "bit_stati_oborotov_naimenovanie", "match_type": "contains_any", "values": ["vpn access"]}
    out2 = rules_from_frame(labels_to_rules(reviewed, cfg.CLASSIFICATION_RULES))
    assert out2[0]["priority"] == 1009
