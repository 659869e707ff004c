"""Row identity: dense sequence numbers and the payment content hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import in_own_methods, ustrip
from ledgerlens.session import remove_table, table_path, write_table, written


def with_dense_index(
    df: DataFrame,
    name: str,
    order_cols: list[Column] | None = None,
    start: int = 0,
    keys: list[str] | None = None,
    expected: int = 0,
) -> DataFrame:
    """Attach a dense 0..n-1 (or ``start``-based) index without a one-task window.

    The frame, range-sorted if ``order_cols`` are given, is written once to
    the shared folder with each row's partition and place in it.  Counts per
    partition and positions both come from that table, so they always agree;
    the offsets (one row per partition) are broadcast.  Without
    ``order_cols`` numbers follow the frame's partitions: one file's rows in
    their order, but several files in the order Spark packs them.  Runs the
    write when called.  ``keys`` names the columns of an order that is ascending with
    NULLs first, so that many rows, of which about so many are ``expected``, can be
    sorted in passes.
    """
    if order_cols:
        placed = _written_in_order(df, order_cols, keys, expected)
    else:
        placed = written(df.withColumn("__place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    running = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__off"))
    within = F.col("__place").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__off") + within + F.lit(start)).cast("long"))
        .drop("__place", "__part", "__off")
    )


#: Rows that one pass of a sort shuffles; its shuffle files are gone before the next one.
PASS_ROWS = 60_000_000
#: Partition numbers that each pass has for its own.
PASS_PARTITIONS = 1 << 20
#: Rows, about, of the sample that passes are cut by.
SAMPLE_ROWS = 4_000


def _written_in_order(df: DataFrame, order_cols: list[Column], keys: list[str] | None, expected: int) -> DataFrame:
    """The rows in order, each with its partition and place in it (``__place``).

    Where ``keys`` names the columns that the order follows, more than PASS_ROWS expected
    rows are written as they come and sorted in passes, each over one range of the order;
    ranges are cut by sampled rows, and where the cuts lie changes no row's number."""
    spark, path = df.sparkSession, None
    rows, cuts, passed = df, [], []
    if keys and expected > PASS_ROWS:
        path = table_path(spark, "unsorted")
        write_table(df, path)
        rows = spark.read.schema(df.schema).parquet(path)
        count = rows.count()
        passes = -(-count // PASS_ROWS)
        sample = rows.select(*keys).sample(min(1.0, SAMPLE_ROWS / max(1, count)), seed=0).orderBy(*order_cols).collect()
        cuts = [sample[i * len(sample) // passes] for i in range(1, passes)] if len(sample) >= passes else []
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = rows
        if low is not None:
            part = part.where(F.struct(*keys) >= _row_literal(rows, low))
        if high is not None:
            part = part.where(F.struct(*keys) < _row_literal(rows, high))
        place = F.monotonically_increasing_id() + F.lit(i * PASS_PARTITIONS << 33)
        passed.append(written(part.orderBy(*order_cols).withColumn("__place", place), "placed"))
    if path:
        remove_table(spark, path)
    return reduce(DataFrame.union, passed)


def _row_literal(df: DataFrame, row: Row) -> Column:
    """A row of some columns as a constant; structs compare like ascending keys, NULLs first."""
    return F.struct(*[F.lit(value).cast(df.schema[name].dataType).alias(name) for name, value in row.asDict().items()])


def stable_key_text(col: Column, kind: str) -> Column:
    """Value -> key fragment: NULL -> '', timestamps as 'yyyy-MM-dd HH:mm:ss',
    amounts as the full text of the double, strings stripped."""
    if kind == "timestamp":
        text = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    elif kind == "amount":
        text = F.when(~F.isnan(col.cast("double")), col.cast("double").cast("string"))
    else:
        text = in_own_methods(ustrip(col.cast("string")), col.cast("string"))
    return F.coalesce(text, F.lit(""))


def payment_id(parts: list[Column]) -> Column:
    """md5 of the '|'-joined fragments (NULLs already mapped to '')."""
    return F.md5(F.concat_ws("|", *parts))
