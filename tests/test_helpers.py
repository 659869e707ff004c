import numpy as np

from ledgerlens.functions.ids import with_dense_index
from ledgerlens.functions.quantiles import exact_quantiles


def test_exact_quantiles_match_numpy_with_hot_group(spark):
    rng = np.random.default_rng(7)
    rows = []
    # one hot group holding most rows, several small ones, one of size 1
    for g, n in (("hot", 3000), ("a", 5), ("b", 4), ("c", 1)):
        for v in rng.normal(100, 30, n).round(2):
            rows.append((g, float(v)))
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    out = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75]).collect()}
    for g in ("hot", "a", "b", "c"):
        vals = np.array([v for k, v in rows if k == g])
        expected = np.quantile(vals, [0.25, 0.5, 0.75], method="linear")
        got = [out[g]["q_0"], out[g]["q_1"], out[g]["q_2"]]
        assert np.allclose(got, expected, rtol=0, atol=1e-9), (g, got, expected)
        assert out[g]["n"] == len(vals)


def test_dense_index_input_order(spark):
    df = spark.range(0, 5000, 1, 9)
    out = with_dense_index(df, "seq").collect()
    assert sorted(r["seq"] for r in out) == list(range(5000))
    # input order: within the range source, seq follows id
    assert all(r["seq"] == r["id"] for r in out)


def test_dense_index_many_rows_with_kept_column(spark):
    """More partitions than cores, and a carried column that is no sort key."""
    from pyspark.sql import functions as F

    n = 3_000_000
    df = spark.range(0, n, 1, 24).select(
        F.pmod(F.xxhash64("id"), F.lit(n)).alias("key"), F.concat(F.lit("row "), F.col("id")).alias("carried"), "id"
    )
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        out = with_dense_index(df, "seq", [F.col("key").asc()])
        row = out.agg(
            F.count(F.lit(1)), F.count_distinct("seq"), F.max("seq"), F.count_distinct("carried"), F.min("seq")
        ).first()
        later = out.alias("a").join(out.alias("b"), F.expr("b.seq = a.seq + 1")).where("a.key > b.key").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert tuple(row) == (n, n, n - 1, n, 0)
    assert later == 0


def test_payment_ids_keep_full_amounts(spark):
    from ledgerlens.operators.marts import payment_id_column

    amounts = [10.001, 10.004, 2e16, 3e16, 0.1 + 0.2, 0.3, None]
    df = spark.createDataFrame([(a, "v") for a in amounts], "summa double, kontragenti_naimenovanie string")
    assert df.select(payment_id_column(df).alias("id")).distinct().count() == len(amounts)


def test_sums_survive_huge_and_tiny_amounts(spark):
    from pyspark.sql import functions as F

    from ledgerlens.functions.amounts import exact_sum

    def total(values):
        return spark.createDataFrame([(v,) for v in values], "a double").agg(exact_sum(F.col("a"))).first()[0]

    assert total([1e23, 1.5, None]) == 1e23
    assert total([1e30, 1e30]) == 2e30
    assert total([4e-12, 5e-12]) == 9e-12
    assert total([0.1] * 10) == 1.0
    assert total([]) == 0.0 == total([None])
    assert total([9e27] * 20) == 1.8e29


def test_slug_column_equals_python_form(spark):
    from pyspark.sql import functions as F

    from ledgerlens.functions.slug import slug_column, slugify_text
    from ledgerlens.sources.csv_source import column_alias

    labels = ["ООО Ромашка", " Vendor  A ", "---", "", "  ", "naïve café", "a日b", "日本", "Ёж / Щука", "x™", "Į_1", None, "№ 5"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {r["label"]: r["s"] for r in df.select("label", slug_column(F.col("label")).alias("s")).collect()}
    assert got == {x: slugify_text(x or "") for x in labels}
    assert got["naïve café"] == "naive_cafe" and got["a日b"] == "ab" and got["---"] == "u_2d_2d_2d"
    assert got["日本"] == "u_65e5_672c" and got["  "] == "unknown" and got["Ёж / Щука"] == "ezh_schuka"
    assert [column_alias(x) for x in ("Сумма", "Организации (наименование)", "year num", "2025", "-", "TM™")] == [
        "summa", "organizatsii_naimenovanie", "year_num", "column_2025", "column", "tmtm",
    ]


def test_shared_folder_is_required_off_local_mode():
    import pytest

    from ledgerlens.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
