"""The join form of the classifier (q-gram index) against a plain loop and the expression form."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens import config as cfg
from ledgerlens.operators import classify as D

COLUMNS = cfg.FEATURE_COLUMNS
SCHEMA = "id int, " + ", ".join(f"`{c}` string" for c in COLUMNS)
WORDS = ["hosting", "лиц", "crm", "а", "1c", "cloud", "облако", "x", "security", "ab", "оплата", "vpn", "microsoft 365"]


def generated_rules(n, seed, wild=True, strict=False):
    rng = random.Random(seed)
    rules = []
    for i in range(n):
        conditions = []
        for _ in range(rng.randrange(1, 4)):
            values = []
            for _ in range(rng.randrange(1, 4)):
                value = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 3)))
                value = rng.choice([value, value.upper(), f" {value} ", value + str(rng.randrange(30))])
                if wild and rng.random() < 0.04:
                    value = rng.choice(["*", " * ", "", " "])
                values.append(value)
            kind = rng.choice(["contains_any", "equals_any", "in_list", "regex_any"]) if strict else "contains_any"
            if kind == "regex_any":
                values = [rng.choice(["^vpn", "[0-9]+$", "a+b", "лиц|облако"]) for _ in values]
            conditions.append({"column": rng.choice(COLUMNS), "match_type": kind, "values": values})
        rules.append({
            "rule_id": f"r{i}", "priority": rng.randrange(n), "confidence": rng.choice([0.3, 0.6, 0.9]),
            "target": {"l1": f"l{i % 5}", "l2": f"m{i % 7}", "l3": f"n{i}"}, "conditions": conditions,
        })
    return rules


def generated_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        cells = []
        for _ in COLUMNS:
            text = " ".join(rng.choice(WORDS) + rng.choice(["", str(rng.randrange(30))]) for _ in range(rng.randrange(0, 4)))
            cells.append(rng.choice([text, text.upper(), "  " + text, None if rng.random() < 0.2 else text]))
        rows.append((i, *cells))
    rows += [(n + i, *rows[0][1:]) for i in range(50)]  # a hot tuple
    return rows


def plain_winner(features, rules):
    """(rule_id, vendor pattern, article pattern, keywords) by a loop over all rules."""
    best = None
    for idx, rule in enumerate(rules):
        art = ven = False
        shown = {"A": None, "V": None}
        keywords, in_column = [], {c: False for c in cfg.KEYWORD_COLUMNS}
        for cond in rule["conditions"]:
            value, column = features[cond["column"]], cond["column"]
            kind = "A" if column in cfg.ARTICLE_COLUMNS else "V" if column in cfg.VENDOR_COLUMNS else "O"
            hit = "*" in cond["values"] or any(v.lower() in value for v in cond["values"])
            art |= kind == "A" and hit
            ven |= kind == "V" and hit
            for v in cond["values"]:
                norm = v.strip().lower()
                if kind != "O" and shown[kind] is None and (norm == "*" or norm in value):
                    shown[kind] = v
                if column in cfg.KEYWORD_COLUMNS and norm not in ("", "*"):
                    where = [c for c in cfg.KEYWORD_COLUMNS if norm in features[c]]
                    if where and norm not in keywords:
                        keywords.append(norm)
                    for c in where:
                        in_column[c] = True
        score = min(sum(cfg.KEYWORD_WEIGHTS[c] for c in cfg.KEYWORD_COLUMNS if in_column[c]), 1.0)
        tier = 1 if art else 2 if ven else 3 if score > 0 else None
        key = (tier, -score if tier == 3 else 0.0, idx)
        if tier and (best is None or key < best[0]):
            vendor = shown["V"] if tier == 2 or (tier == 1 and ven) else None
            best = (key, (rule["rule_id"], vendor, shown["A"] if tier == 1 else None, ", ".join(keywords)))
    return best[1] if best else (None, None, None, "")


def outputs(df):
    return sorted((tuple(r) for r in df.select("id", *D.CLASSIFICATION_OUTPUT_COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("strict", [False, True])
def test_equals_expression_form_on_generated_rules(spark, strict):
    df = spark.createDataFrame(generated_rows(150, 1), SCHEMA)
    for seed in (1, 2):
        rules = generated_rules(60, seed, wild=seed == 1, strict=strict)
        assert outputs(D.classify(df, rules, "join", strict)) == outputs(D.classify(df, rules, "expression", strict))


def test_ten_thousand_rules(spark):
    rules = generated_rules(10_000, 7, wild=False)
    rng = random.Random(9)
    for rule in rules:  # mostly patterns of their own, so that winners differ
        for cond in rule["conditions"]:
            if rng.random() < 0.97:
                cond["values"] = [f"{v.strip()} q{rng.randrange(4000)}" for v in cond["values"]]
    rows = generated_rows(60, 4)
    for i in range(0, 60, 2):
        pattern = rng.choice(rng.choice(rules)["conditions"])
        cells = list(rows[i])
        cells[1 + COLUMNS.index(pattern["column"])] = f"xx {pattern['values'][0]} yy"
        rows[i] = tuple(cells)
    df = spark.createDataFrame(rows, SCHEMA)
    ordered = D.active_rules(rules)
    got = D.classify(df, rules, "join").select(
        "id", "matched_rule_id", "matched_vendor_pattern", "matched_article_pattern", "matched_keywords"
    )
    got = {r[0]: tuple(r)[1:] for r in got.collect()}
    for row in rows:
        features = dict(zip(COLUMNS, ((c or "").strip().lower() for c in row[1:]), strict=True))
        assert got[row[0]] == plain_winner(features, ordered)
    assert len({r[0] for r in got.values()}) > 20


def test_plan_has_no_nested_loop(spark):
    df = spark.createDataFrame(generated_rows(20, 2), SCHEMA)
    plan = D.classify(df, generated_rules(30, 3), "join")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_containing_values_of_any_length(spark):
    values = [("a", v) for v in ["", "x", "ab", "abc", "abcd", "zabcabc", "яшма", "ab c"]] + [("b", "abc")]
    needles = [("a", n) for n in ["x", "ab", "abc", "bca", "яш", "zz", "abcdefgh", "b c", "c"]] + [("b", "bc")]
    got = D.containing_values(
        spark.createDataFrame(values, "column string, value string"),
        spark.createDataFrame(needles, "column string, needle string"), [1, 2, 3],
    )
    want = sorted((c, v, n) for c, v in values for d, n in needles if c == d and n in v)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_empty_inputs(spark):
    df = spark.createDataFrame(generated_rows(5, 2), SCHEMA)
    assert {r["matched_rule_id"] for r in D.classify(df, [], "join").collect()} == {None}
    assert D.classify(df.where(F.lit(False)), generated_rules(5, 1), "join").count() == 0
