"""Skew-safe building blocks: running values over hot keys, first rows, literal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarmatch.sources.tables import settle

def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A parameter table (dictionary, registry, query list) as a local relation."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def struct_array(names: Sequence[str], rows: Sequence[Sequence]) -> Column:
    """Array of structs with the given field names; values are columns or literals."""
    def field(value, name: str) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).alias(name)

    return F.array(*[F.struct(*[field(v, n) for v, n in zip(row, names)]) for row in rows])


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, and what is selected, exploded or grouped from it, joined by shuffle and never sent whole through the driver.

    Before it runs, Spark sizes a table by its compressed file and does not count what an explode adds, so millions of
    short rows pass for a table small enough to broadcast. For sides that grow with the data.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` in as many partitions as shuffles have, by ``keys`` or in turn, for short rows that are about to grow.

    A small file is scanned by one task, and a shuffle of short rows is put together again to a few partitions; what an
    explode or a wide sort makes of them would all be in those tasks. The number is given, so that AQE keeps it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: str | Column) -> DataFrame:
    """One row per key: the one with the lowest ``order``.

    An aggregate, not a window: each map task already reduces a hot key to one row.
    """
    packed = df.select(
        *[k.alias(f"_k{i}") if isinstance(k, Column) else F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        (order if isinstance(order, Column) else F.col(order)).alias("_o"),
        F.struct(*df.columns).alias("_row"),
    )
    names = [f"_k{i}" for i in range(len(keys))]
    return packed.groupBy(*names).agg(F.min_by("_row", "_o").alias("_row")).select("_row.*")


def _stretches(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None) -> DataFrame:
    """``df`` cut by ranges of (keys, order) into stretches of about equally many rows, numbered in ``_part``.

    The ranges are of row ranks, whatever the values of the order are, so a key that holds a third of all rows is a
    third of all stretches. They are written once, as both levels below go over them.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return settle(ranged.withColumn("_part", F.spark_partition_id()), "stretches")


def _null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys that may be null; the left side's columns and the right side's new ones."""
    renamed = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], value: str, out: str, parts: int | None = None
) -> DataFrame:
    """``lag(value)`` per key over a total ``order``, two-level so that no task sorts a whole hot key.

    Inside a stretch it is a window; the value that precedes a stretch comes from one summary row per (key, stretch).
    """
    order = [order] if isinstance(order, str) else list(order)
    cut = _stretches(df, keys, order, parts)
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    lagged = cut.withColumn("_in", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    tails = cut.groupBy(*keys, "_part").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last_v"))
    outer = Window.partitionBy(*keys).orderBy("_part")
    before = tails.select(*keys, "_part", F.lag("_last_v").over(outer).alias("_carried"))
    joined = _null_safe(lagged, before, [*keys, "_part"], "left")
    return joined.withColumn(out, F.coalesce("_in", "_carried")["v"]).drop("_part", "_in", "_carried")


def running_total(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], amounts: dict[str, Column], parts: int | None = None
) -> DataFrame:
    """Inclusive running sums per key over a total ``order``, two-level so that a hot key is spread over many tasks."""
    order = [order] if isinstance(order, str) else list(order)
    cut = _stretches(df.withColumns({f"_a_{n}": amount for n, amount in amounts.items()}), keys, order, parts)
    inner = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(f"_a_{n}").over(inner).alias(f"_i_{n}") for n in amounts])
    sums = cut.groupBy(*keys, "_part").agg(*[F.sum(f"_a_{n}").alias(f"_s_{n}") for n in amounts])
    outer = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_s_{n}").over(outer), F.lit(0)).alias(f"_c_{n}") for n in amounts]
    )
    joined = _null_safe(local, carried, [*keys, "_part"], "inner")
    for name in amounts:
        joined = joined.withColumn(name, F.col(f"_i_{name}") + F.col(f"_c_{name}"))
    return joined.drop("_part", *[f"_{p}_{n}" for n in amounts for p in ("a", "i", "c")])


def spaced_starts(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], asked: str, gap: Column, out: str, parts: int | None = None
) -> DataFrame:
    """``out``: when each row of a key can start, ``gap`` after the start before it or when it is ``asked``, if later.

    start(i) = max(asked(i), start(i-1) + gap) is a prefix scan in (max, +): with i the row's place in its key,
    start(i) = i * gap + max over j <= i of (asked(j) - j * gap). Both the place and the maximum are two-level, over
    stretches of row ranks, so a key with a third of all rows is spread over a third of the stretches; all values are
    whole numbers. ``gap`` is one number per key (null or none: rows start when asked); a null ``asked`` starts never
    and holds up nobody.
    """
    order = [order] if isinstance(order, str) else list(order)
    given = df.withColumn("_gap", F.coalesce(gap.cast("long"), F.lit(0)))
    cut = _stretches(given, keys, order, parts)
    inner = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("_at", F.count(asked).over(inner))
    free = F.col(asked) - F.col("_at") * F.col("_gap")
    local = placed.withColumn("_free", free).withColumn("_most", F.max("_free").over(inner))
    ends = local.groupBy(*keys, "_part").agg(F.max("_at").alias("_n"), F.max("_free").alias("_top"), F.max("_gap").alias("_g"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    summed = ends.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carried = summed.withColumn("_held", F.max(F.col("_top") - F.col("_off") * F.col("_g")).over(before))
    joined = _null_safe(local, carried.select(*keys, "_part", "_off", "_held"), [*keys, "_part"], "inner")
    start = (F.col("_off") + F.col("_at")) * F.col("_gap") + F.greatest(F.col("_most") - F.col("_off") * F.col("_gap"), F.col("_held"))
    return joined.withColumn(out, F.when(F.col(asked).isNotNull(), start)).drop("_part", "_gap", "_at", "_free", "_most", "_off", "_held")


def page_of(df: DataFrame, order: Sequence[Column], first: int, last: int, parts: int | None = None) -> DataFrame:
    """The rows at places ``first`` to ``last - 1`` of a total order, without bringing the rows before them together.

    The rows are cut into ranges of the order, written once; the ranges' counts (a row each) tell which of them hold
    the page, and only their files are read again and numbered.
    """
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    cut = settle(ranged.withColumn("_part", F.spark_partition_id()), "pages")
    counts = cut.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_off", F.coalesce(F.sum("count").over(before), F.lit(0)))
    held = placed.where((F.col("_off") < last) & (F.col("_off") + F.col("count") > first)).collect()
    if not held:
        return df.limit(0)
    offset = F.create_map(*[F.lit(x) for r in held for x in (r["_part"], r["_off"])])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + offset[F.col("_part")]
    page = cut.where(F.col("_part").isin([r["_part"] for r in held])).withColumn("_place", place)
    return page.where((F.col("_place") >= first) & (F.col("_place") < last)).drop("_part", "_place")
