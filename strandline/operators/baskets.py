"""Baskets held through changing weights, carry and rolls, as one series of value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o


def basket_value(members: DataFrame, cost: float = 0.0, start: float = 1.0, keys: str = "basket_id") -> DataFrame:
    """(basket_id, ts, value, traded, cost): what one unit put into a basket comes to.

    members: (basket_id, ts, series_id, price, weight, carry). On a date whose weights are known (not null for any member)
    the basket is dealt anew: units of each are its share of the absolute weights times the value over its price, and
    ``cost`` is paid on all that is bought or sold. Between such dates units stay. Each date adds, per unit held, the
    price's move and the carry. A member without a price keeps its last one; one that has none yet, or a price of zero,
    can't be bought.

    The units depend on the value and the value on the units, so dates are a fold; a date's members are one row.
    """
    one = F.struct("series_id", F.col("price").cast("double").alias("price"), F.col("weight").cast("double").alias("weight"), F.coalesce(F.col("carry").cast("double"), F.lit(0.0)).alias("carry"))
    d = members.groupBy(keys, "ts").agg(F.sort_array(F.collect_list(one)).alias("_m"))  # a date's members
    d = d.select(keys, "ts", *[F.col(f"_m.{c}").alias(f"_{c}") for c in ("series_id", "price", "weight", "carry")])

    def known(x) -> bool:
        return x is not None and x == x

    def step(state, x):
        value, held, last = state
        price = dict(last)
        for name, p, c in zip(x[0], x[1], x[3], strict=True):
            units = held.get(name, 0.0)
            if known(p):
                value += units * (p - price.get(name, p))
                price[name] = p
            value += units * c
        traded = 0.0
        weights = {n: w for n, w in zip(x[0], x[2], strict=True) if known(w)}
        if weights:
            able = {n: w for n, w in weights.items() if price.get(n)}
            total = sum(abs(w) for w in able.values())
            new = {n: w / total * value / price[n] for n, w in able.items()} if total else {}
            traded = sum(abs(new.get(n, 0.0) - held.get(n, 0.0)) * price[n] for n in sorted({*new, *held}))
            value -= cost * traded
            held = new
        return (value, held, price), (value, traded, cost * traded)

    out = o.fold(d, step, (float(start), {}, {}), ["_series_id", "_price", "_weight", "_carry"], "value double, traded double, cost double", keys, "ts")
    return out.select(keys, "ts", "value", "traded", "cost")


def proportional_roll(contracts: DataFrame, rows: int = 5) -> DataFrame:
    """df plus back_weight, price and continuous. Rows are (series_id, ts, period, front, back): in the last ``rows`` rows of a
    period the weight goes from the front contract to the back one in equal steps, all of it on the last. price is the
    mix of the two; continuous is the first price carried on by the returns of what was held since the row before, so a
    roll makes no jump."""
    w, last = o.series(), Window.partitionBy("series_id", "period").orderBy(F.desc("ts"))
    d = contracts.withColumn("_left", F.row_number().over(last) - 1)  # rows to the period's end
    d = d.withColumn("back_weight", F.greatest(F.lit(0.0), (F.lit(float(rows)) - F.col("_left")) / rows))
    d = d.withColumn("price", (1 - F.col("back_weight")) * F.col("front") + F.col("back_weight") * F.col("back"))
    same = F.lag("period").over(w) == F.col("period")
    # what was the back contract is the front one of the next period
    held = F.when(same, (1 - F.lag("back_weight").over(w)) * o.pct_change("front", 1, w) + F.lag("back_weight").over(w) * o.pct_change("back", 1, w)).otherwise(F.try_divide("front", F.lag("back").over(w)) - 1)
    d = d.withColumn("_r", F.coalesce(held, F.lit(0.0)))
    return d.withColumn("continuous", F.first("price").over(o.so_far(w)) * F.product(1 + F.col("_r")).over(o.so_far(w))).drop("_left", "_r")


def reference_returns(df: DataFrame, reference: DataFrame) -> DataFrame:
    """df's first value carried on by the returns of a reference (ts, reference): a series without the jumps of its own
    contracts. Dates that the reference lacks are left out."""
    w = o.series()
    d = df.join(reference, "ts")
    r = F.coalesce(o.pct_change("reference", 1, w), F.lit(0.0))
    d = d.withColumn("_r", r)
    return d.withColumn("continuous", F.first("value").over(o.so_far(w)) * F.product(1 + F.col("_r")).over(o.so_far(w))).drop("_r")
