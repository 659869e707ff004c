import os
import tempfile

from ledgerlens.functions.slug import slugify_text
from ledgerlens.sources import csv_source
from ledgerlens.sources.ingest import missing_required_columns, with_row_seq


def test_column_names():
    assert csv_source.column_alias("Сумма") == "summa"
    assert csv_source.column_alias("Организации (наименование)") == "organizatsii_naimenovanie"
    assert csv_source.column_alias("year num") == "year_num"
    assert csv_source.column_alias("1st") == "column_1st"
    assert csv_source.column_alias("!!!") == "column"


def test_duplicate_headers_do_not_collide(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "a", "a_1")
    out, _ = csv_source.normalize_columns(df)
    assert len(set(out.columns)) == 3


def test_missing_required(spark):
    df = spark.createDataFrame([("2026Q1",)], "quarter_period string")
    assert "summa" in missing_required_columns(df)


def test_csv_delimiter_and_encoding(spark):
    d = tempfile.mkdtemp(prefix="ll-csv-", dir="/tmp")
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8-sig") as fh:
        fh.write("quarter_period;report_type\n2026Q1;fact\n")
    delim = csv_source.detect_delimiters(spark, os.path.join(d, "a.csv")).first()["delimiter"]
    assert delim == ";"
    df = csv_source.read_payments_csv(spark, os.path.join(d, "a.csv"))
    assert df.columns == ["quarter_period", "report_type"] and df.count() == 1
    d2 = tempfile.mkdtemp(prefix="ll-csv-", dir="/tmp")
    with open(os.path.join(d2, "b.csv"), "w", encoding="cp1251") as fh:
        fh.write("name,summa\nОплачен,10\nТест,20\n")
    df2 = csv_source.read_payments_csv(spark, os.path.join(d2, "b.csv"), separator=",")
    assert sorted(r["name"] for r in df2.collect()) == ["Оплачен", "Тест"]


def test_slugify():
    assert slugify_text("ООО Контур") == "ooo_kontur"
    assert slugify_text("Café №1") == "cafe_No1"  # lower() runs before NFKD
    assert slugify_text("   ") == "unknown"
    assert slugify_text("ъь") == "u_44a_44c"


def test_dense_row_seq(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("cast(id % 13 as string) as k", "id")
    seq = with_row_seq(df, ["k", "id"]).select("_row_seq").collect()
    assert sorted(r[0] for r in seq) == list(range(1000))


def test_folder_of_mixed_delimiters_and_encodings(spark, tmp_path):
    """Each file by its own delimiter and encoding, rows numbered in file order."""
    from ledgerlens.config import REQUIRED_COLUMNS
    from ledgerlens.sources.csv_source import file_formats, read_payments_csv
    from ledgerlens.sources.ingest import ingest_exports

    header = list(REQUIRED_COLUMNS)

    def rows(file, n):
        return [[f"{file}-{i}-{c}" if c != "summa" else f"{i}" for c in header] for i in range(n)]

    files = {"a.csv": (";", "utf-8", rows("Тест", 40)), "b.csv": (",", "cp1251", rows("Оплата", 3)), "c.csv": ("|", "utf-8-sig", rows("x", 5))}
    for name, (sep, encoding, body) in files.items():
        text = "\n".join(sep.join(r) for r in [header, *body]) + "\n"
        (tmp_path / name).write_bytes(text.encode(encoding))
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.legacy.javaCharsets", None)
    formats = {r["file"].rsplit("/", 1)[1]: (r["delimiter"], r["encoding"]) for r in file_formats(spark, str(tmp_path)).collect()}
    assert formats == {"a.csv": (";", "UTF-8"), "b.csv": (",", "windows-1251"), "c.csv": ("|", "UTF-8")}
    assert read_payments_csv(spark, str(tmp_path)).count() == 48
    out = ingest_exports(spark, str(tmp_path)).orderBy("_row_seq").collect()
    expected = [r for name in sorted(files) for r in files[name][2]]
    assert [[r[c] for c in header] for r in out] == expected
    assert [r["_row_seq"] for r in out] == list(range(48))
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.legacy.javaCharsets", None))
