import copy

from ledgerlens import config as cfg
from ledgerlens.operators.classify import build_review_queue, classify_payments

SCHEMA = ", ".join(f"{c} string" for c in cfg.FEATURE_COLUMNS)


def record(**values):
    return tuple(values.get(c, "") for c in cfg.FEATURE_COLUMNS)


def classify_one(spark, rules=None, **values):
    df = spark.createDataFrame([record(**values)], SCHEMA)
    return classify_payments(df, rules).first()


def test_article_beats_vendor(spark):
    r = classify_one(spark, bit_stati_oborotov_naimenovanie="hosting services", kontragenti_naimenovanie="kaspersky")
    assert (r["l1_category"], r["matched_rule_id"], r["classification_confidence"]) == (
        "infrastructure", "infra_cloud_hosting", "high")
    assert r["matched_article_pattern"] == "hosting"
    assert "article" in r["classification_reason"]


def test_vendor_second(spark):
    r = classify_one(spark, bit_stati_oborotov_naimenovanie="security subscription", kontragenti_naimenovanie="kaspersky lab")
    assert (r["l1_category"], r["l3_category"]) == ("information_security", "endpoint_protection")
    assert "vendor" in r["classification_reason"]
    assert r["matched_vendor_pattern"] == "kaspersky"


def test_unmatched_goes_to_queue(spark):
    df = spark.createDataFrame([record(bit_stati_oborotov_naimenovanie="misc payment", kontragenti_naimenovanie="unknown vendor")], SCHEMA)
    out = classify_payments(df)
    r = out.first()
    assert (r["l1_category"], r["classification_confidence"], r["review_required"]) == ("other_it", "unclassified", True)
    assert r["classification_reason"] == "No matching classification rule"
    assert r["matched_rule_id"] is None and r["classification_confidence_score"] == 0.0
    queue = build_review_queue(out)
    assert queue.count() == 1 and queue.columns[:8] == cfg.REVIEW_COLUMNS


def test_keyword_tier(spark):
    r = classify_one(
        spark,
        naznachenie_platezha="crm implementation support services",
        dogovori_kontragentov_naimenovanie="implementation support contract",
    )
    assert r["l1_category"] == "development_and_support"
    assert "keywords=" in r["classification_reason"]
    assert r["matched_keywords"] == "implementation, support"
    # 0.85 base + (0.3 purpose + 0.2 contract) * 0.15
    assert r["classification_confidence_score"] == round(0.85 + 0.5 * 0.15, 4)


def test_tier_beats_priority_and_dead_columns(spark):
    # vendor 'mts' (priority 140 rule) vs article 'доменов' (priority 55): article wins regardless
    r = classify_one(spark, bit_stati_oborotov_naimenovanie="оплата доменов", kontragenti_naimenovanie="mts")
    assert r["matched_rule_id"] == "infrastructure_dns_domains_ru"
    # project 'crm' alone never counts (dead column)
    r = classify_one(spark, proekti_naimenovanie="crm")
    assert r["matched_rule_id"] is None


def test_custom_rules_medium_low_and_mixed_star(spark):
    rules = [
        {"rule_id": "r_low", "priority": 1, "confidence": 0.2, "target": {"l1": "other_it", "l2": "unclassified", "l3": "misc_services"},
         "conditions": [{"column": "naznachenie_platezha", "match_type": "contains_any", "values": ["alpha"]}]},
        {"rule_id": "r_med", "priority": 2, "confidence": 0.6, "target": {"l1": "other_it", "l2": "unclassified", "l3": "misc_software"},
         "conditions": [{"column": "kontragenti_naimenovanie", "match_type": "equals_any", "values": ["beta"]}]},
        {"rule_id": "r_star", "priority": 3, "confidence": 0.5, "target": {"l1": "other_it", "l2": "unclassified", "l3": "misc_hardware"},
         "conditions": [{"column": "naznachenie_platezha", "match_type": "contains_any", "values": ["gamma"]},
                        {"column": "bit_stati_oborotov_kodifikator", "match_type": "in_list", "values": ["*"]}]},
        {"rule_id": "fallback", "priority": 0, "confidence": 0.3, "target": {"l1": "other_it", "l2": "unclassified", "l3": "review_required"},
         "conditions": [{"column": "bit_stati_oborotov_naimenovanie", "match_type": "in_list", "values": ["*"]}]},
    ]
    low = classify_one(spark, rules, naznachenie_platezha="alpha")
    # keyword only: 0.2 + 0.3*0.15 = 0.245 -> low; but r_star's '*' article condition always hits -> article tier wins
    assert low["matched_rule_id"] == "r_star"
    assert low["classification_confidence"] == "low"  # 0.5 + 0.1 = 0.6 < 0.65
    rules_no_star = [r for r in rules if r["rule_id"] != "r_star"]
    low = classify_one(spark, rules_no_star, naznachenie_platezha="alpha")
    assert (low["matched_rule_id"], low["classification_confidence"], low["review_required"]) == ("r_low", "low", True)
    med = classify_one(spark, rules_no_star, kontragenti_naimenovanie="xx beta xx")  # equals_any behaves like contains
    assert (med["matched_rule_id"], med["classification_confidence"]) == ("r_med", "medium")
    none = classify_one(spark, rules_no_star, bit_stati_oborotov_naimenovanie="zzz")
    assert none["matched_rule_id"] is None  # the all-'*' fallback never fires


def test_expression_is_config_independent_of_input_order(spark):
    rules = copy.deepcopy(cfg.CLASSIFICATION_RULES)[::-1]  # reversed list; priority decides
    r = classify_one(spark, rules, bit_stati_oborotov_naimenovanie="hosting services", kontragenti_naimenovanie="kaspersky")
    assert r["matched_rule_id"] == "infra_cloud_hosting"


def test_join_form_equals_expression_form(spark):
    from ledgerlens.operators.classify import CLASSIFICATION_OUTPUT_COLUMNS, classify_payments_join

    rows = [
        record(bit_stati_oborotov_naimenovanie="hosting services", kontragenti_naimenovanie="kaspersky"),
        record(bit_stati_oborotov_naimenovanie="security subscription", kontragenti_naimenovanie="kaspersky lab"),
        record(bit_stati_oborotov_naimenovanie="misc payment", kontragenti_naimenovanie="unknown vendor"),
        record(naznachenie_platezha="crm implementation support services",
               dogovori_kontragentov_naimenovanie="implementation support contract"),
        record(bit_stati_oborotov_naimenovanie="  Microsoft 365 ", dogovori_kontragentov_naimenovanie="1-urgent license"),
        record(bit_stati_oborotov_naimenovanie="оплата доменов", kontragenti_naimenovanie="рег.ру mts"),
        record(),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    cols = ["bit_stati_oborotov_naimenovanie", "kontragenti_naimenovanie", "naznachenie_platezha"] + CLASSIFICATION_OUTPUT_COLUMNS
    a = sorted(tuple(r) for r in classify_payments(df).select(*cols).collect())
    b = sorted(tuple(r) for r in classify_payments_join(df).select(*cols).collect())
    assert a == b


def test_strict_match_types_option(spark):
    rules = [
        {"rule_id": "eq", "priority": 1, "confidence": 0.9,
         "target": {"l1": "other_it", "l2": "unclassified", "l3": "misc_services"},
         "conditions": [{"column": "kontragenti_naimenovanie", "match_type": "equals_any", "values": ["beta"]}]},
        {"rule_id": "rx", "priority": 2, "confidence": 0.9,
         "target": {"l1": "other_it", "l2": "unclassified", "l3": "misc_software"},
         "conditions": [{"column": "bit_stati_oborotov_kodifikator", "match_type": "regex_any", "values": ["^it[0-9]+$"]}]},
    ]
    df = spark.createDataFrame([record(kontragenti_naimenovanie="xx beta xx"), record(bit_stati_oborotov_kodifikator="IT001")], SCHEMA)
    loose = [r["matched_rule_id"] for r in classify_payments(df, rules).collect()]
    strict = [r["matched_rule_id"] for r in classify_payments(df, rules, strict_match_types=True).collect()]
    assert loose == ["eq", None]  # substring semantics: regex text is not a substring of 'it001'
    assert strict == [None, "rx"]


def test_strict_match_types_join_form_agrees(spark):
    from ledgerlens.operators.classify import classify

    rules = [
        {"rule_id": "eq", "priority": 1, "confidence": 0.9,
         "target": {"l1": "other_it", "l2": "unclassified", "l3": "misc_services"},
         "conditions": [{"column": "kontragenti_naimenovanie", "match_type": "equals_any", "values": ["beta"]}]},
        {"rule_id": "rx", "priority": 2, "confidence": 0.9,
         "target": {"l1": "other_it", "l2": "unclassified", "l3": "misc_software"},
         "conditions": [{"column": "bit_stati_oborotov_kodifikator", "match_type": "regex_any", "values": ["^it[0-9]+$"]}]},
    ]
    df = spark.createDataFrame([record(kontragenti_naimenovanie="xx beta xx"), record(kontragenti_naimenovanie="beta"),
                                record(bit_stati_oborotov_kodifikator="IT001")], SCHEMA)
    for strict in (False, True):
        expr = sorted((r["kontragenti_naimenovanie"], r["matched_rule_id"] or "") for r in
                      classify(df, rules, form="expression", strict_match_types=strict).collect())
        join = sorted((r["kontragenti_naimenovanie"], r["matched_rule_id"] or "") for r in
                      classify(df, rules, form="join", strict_match_types=strict).collect())
        assert expr == join
