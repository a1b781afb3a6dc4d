"""Running values over ordered rows that stay distributed when a key is hot.

A plain window sorts all rows of one key in one task. `running` cuts the rows of a key into
parts by the first column of their order (months, stretches of numbers), sums each part, runs over
those few sums and hands every part what the earlier ones carry, as a row in front of its
own. Without keys the ordered rows are cut into range partitions instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlab.session import cut_lineage

# Neighbouring whole numbers of an order that lie in one part.
STRETCH = 4096


def ordering(names: list[str]) -> list[Column]:
    """Sort columns from names; a leading '-' sorts that one descending."""
    return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n).asc() for n in names]


def part_of(df: DataFrame, name: str) -> Column:
    """What rows that are neighbours in the order of a column have in common."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.date_trunc("month", F.col(name))
    if kind == "string":
        return F.substring(name, 1, 2)
    return F.floor(F.col(name) / STRETCH)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Add running sums and last non-null values per key in the given order.

    `keys` plus `order` must identify a row. With `include_current=False` the values are
    those before the row. `lasts` needs an ascending order. `sums` of `lit(1)` numbers rows.
    """
    sums, lasts = sums or {}, lasts or {}
    end = 0 if include_current else -1
    if keys:
        return _in_parts(df, keys, order, sums, lasts, end)

    # Adaptive execution may merge neighbouring ranges when the rows are few; the numbers
    # written beside the rows are those of the ranges that were in fact made.
    ranged = df.repartitionByRange(*ordering(order))
    cut = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))

    w = Window.partitionBy("_part").orderBy(*ordering(order)).rowsBetween(
        Window.unboundedPreceding, end
    )
    local = cut.select("*", *_window_values(w, sums, lasts))
    carry = _carry(cut, order, sums, lasts)

    # `carry` has fewer rows than there are partitions: safe to broadcast.
    joined = local.join(F.broadcast(carry), local["_part"] == carry["_c_part"], "left")
    kept = [local[c] for c in df.columns]
    values = [
        (local[n] + F.coalesce(carry[f"_c_{n}"], F.lit(0))).cast(local.schema[n].dataType).alias(n)
        for n in sums
    ]
    values += [F.coalesce(local[n], carry[f"_c_{n}"]).alias(n) for n in lasts]
    return joined.select(*kept, *values)


def _in_parts(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    lasts: dict[str, Column],
    end: int,
) -> DataFrame:
    """Running values by parts of each key: only sums of parts meet in one task per key."""
    first = order[0].lstrip("-")
    taken = {f"_v_{n}": e for n, e in (sums | lasts).items()}
    rows = df.withColumns({"_part": part_of(df, first), "_row": F.lit(1), **taken})
    place = F.struct(*[n.lstrip("-") for n in order])
    totals = [F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums]
    totals += [
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_v_{n}")
        for n in lasts
    ]
    parts = rows.groupBy(*keys, "_part").agg(*totals)
    way = F.col("_part").desc() if order[0].startswith("-") else F.col("_part").asc()
    before = Window.partitionBy(*keys).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        *keys, "_part", F.lit(0).alias("_row"),
        *[F.sum(f"_v_{n}").over(before).alias(f"_v_{n}") for n in sums],
        *[F.last(f"_v_{n}", ignorenulls=True).over(before).alias(f"_v_{n}") for n in lasts],
    )
    kinds = {f"_v_{n}": F.col(f"_v_{n}").cast(carry.schema[f"_v_{n}"].dataType) for n in sums}
    both = rows.withColumns(kinds).unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_part").orderBy("_row", *ordering(order)).rowsBetween(
        Window.unboundedPreceding, end
    )
    values = _window_values(
        w, {n: F.col(f"_v_{n}") for n in sums}, {n: F.col(f"_v_{n}") for n in lasts}
    )
    return both.select("*", *values).filter("_row = 1").select(*df.columns, *sums, *lasts)


def _window_values(w, sums: dict[str, Column], lasts: dict[str, Column]) -> list[Column]:
    out = [F.coalesce(F.sum(e).over(w), F.lit(0)).alias(n) for n, e in sums.items()]
    return out + [F.last(e, ignorenulls=True).over(w).alias(n) for n, e in lasts.items()]


def _carry(
    cut: DataFrame, order: list[str], sums: dict[str, Column], lasts: dict[str, Column]
) -> DataFrame:
    """What each range partition receives from the earlier ones."""
    place = F.struct(*order) if lasts else None
    totals = [F.sum(e).alias(n) for n, e in sums.items()]
    totals += [F.max_by(e, F.when(e.isNotNull(), place)).alias(n) for n, e in lasts.items()]
    edges = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *totals)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return edges.select(
        F.col("_part").alias("_c_part"),
        F.count("_n").over(before).alias("_before"),
        *[F.sum(n).over(before).alias(f"_c_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
    ).filter(F.col("_before") > 0).drop("_before")


def number_rows(df: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """Place of each row in the whole table's order, from 1."""
    return running(df, [], order, sums={out: F.lit(1).cast("long")})


def placed(ordered: DataFrame, out: str = "place") -> DataFrame:
    """The place of each row of a sorted table, from 1, as it comes out."""
    rows = ordered.withColumn("_at", F.monotonically_increasing_id())
    return number_rows(rows, ["_at"], out).drop("_at")


def trailing_mean(
    df: DataFrame, order: list[str], value: Column, n: int, out: str, block: int = 100_000
) -> DataFrame:
    """Mean of `value` over the last `n` rows of the whole table's order.

    Numbered rows are cut into blocks, each with the `n - 1` rows before it, so that every
    block is a task of bounded size.
    """
    block = max(block, n)
    place = F.col("_rn") - 1
    numbered = number_rows(df, order, "_rn").withColumn("_block", F.floor(place / block))
    copies = F.when(
        place % block >= block - (n - 1), F.array(F.col("_block"), F.col("_block") + 1)
    ).otherwise(F.array(F.col("_block")))
    w = Window.partitionBy("_in").orderBy("_rn").rowsBetween(-(n - 1), 0)
    return (
        numbered.withColumn("_in", F.explode(copies))
        .withColumn(out, F.avg(value).over(w))
        .filter(F.col("_in") == F.col("_block"))
        .drop("_in", "_block", "_rn")
    )


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key (last write wins), combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_row")).select(*keys, "_row.*").select(df.columns)


def top_n_by(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first `n` rows per key; Spark keeps only `n` per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*ordering(order))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
