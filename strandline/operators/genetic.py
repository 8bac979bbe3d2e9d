"""Genetic search for trading rules: rules are data, a generation is one Spark job, selection is the driver's."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered as o
from . import select, signals

Rule = tuple[str, tuple[tuple[str, str, float], ...]]  # connective, clauses


def text_of(rule: Rule) -> str:
    return f" {rule[0]} ".join(f"({f} {op} {x!r})" for f, op, x in rule[1])


def fitness(df: DataFrame, rules: Sequence[str], penalty: float = 0.1) -> DataFrame:
    """(rule_id, total_return, max_drawdown, fitness) of all rules in one pass: df has series_id, ts, value and features.

    In the market from a Monday on which the rule holds to the next; the return of a row counts if in it the row before.
    """
    d = df.withColumn("_r", o.pct_change("value", 1, o.series()))
    on = F.array(*[F.struct(F.lit(i).alias("rule_id"), select.rule(t).alias("on")) for i, t in enumerate(rules)])
    d = d.select("series_id", "ts", "_r", F.explode(on).alias("_x")).select("series_id", "ts", "_r", "_x.rule_id", "_x.on")
    w = o.series(("series_id", "rule_id"))
    d = d.withColumn("_pos", signals.hold_mondays(F.col("on"), w).cast("int"))
    d = d.withColumn("_g", F.coalesce(F.lag("_pos").over(w) * F.col("_r"), F.lit(0.0)))
    d = d.withColumn("_eq", F.product(1 + F.col("_g")).over(o.so_far(w))).withColumn("_dd", F.col("_eq") / F.max("_eq").over(o.so_far(w)) - 1)
    g = d.groupBy("series_id", "rule_id").agg((F.product(1 + F.col("_g")) - 1).alias("total_return"), F.min("_dd").alias("max_drawdown"))
    return g.withColumn("fitness", F.col("total_return") - penalty * F.abs("max_drawdown"))


def thresholds(df: DataFrame, features: Sequence[str], at: Sequence[float] = tuple(i / 20 for i in range(2, 19))) -> dict[str, list[float]]:
    """Quantiles of each feature, from one aggregation."""
    row = df.agg(*[F.percentile(f, F.array(*map(F.lit, at))).alias(f) for f in features]).first()
    return {f: sorted(set(row[f] or [0.0])) for f in features}


class Search:
    """Random rules, an elite that stays, mutation and crossover, all from one seed."""

    def __init__(self, cuts: dict[str, list[float]], seed: int = 42, clauses: int = 4) -> None:
        self.cuts, self.random, self.most = cuts, random.Random(seed), clauses

    def clause(self) -> tuple[str, str, float]:
        f = self.random.choice(sorted(self.cuts))
        return f, self.random.choice((">", "<")), round(self.random.choice(self.cuts[f]), 8)

    def rule(self) -> Rule:
        return self.random.choice("&|"), tuple(self.clause() for _ in range(self.random.randint(1, self.most)))

    def mutate(self, r: Rule) -> Rule:
        c = list(r[1])
        if self.random.random() < 0.5 or len(c) >= self.most:
            c[self.random.randrange(len(c))] = self.clause()
        else:
            c.append(self.clause())
        return r[0], tuple(c)

    def cross(self, a: Rule, b: Rule) -> Rule:
        return "&", (self.random.choice(a[1]), self.random.choice(b[1]))

    def run(self, df: DataFrame, population: int = 24, generations: int = 3, elite: int = 6, target: float | None = None) -> list[dict]:
        """Best rules, by mean return over series, of the last generation: rule, total_return, fitness."""
        rules, best = [self.rule() for _ in range(population)], None
        ranked: list[dict] = []
        for _ in range(generations):
            got = fitness(df, [text_of(r) for r in rules]).groupBy("rule_id").agg(F.avg("total_return").alias("r"), F.avg("fitness").alias("f")).collect()
            ranked = sorted(({"rule": rules[x["rule_id"]], "total_return": x["r"], "fitness": x["f"]} for x in got), key=lambda x: (-x["fitness"], text_of(x["rule"])))
            top = max(ranked, key=lambda x: x["total_return"])
            best = top if best is None or top["total_return"] > best["total_return"] else best
            if target is not None and best["total_return"] >= target:
                break
            keep = [x["rule"] for x in ranked[:elite]]
            rules = list(keep)
            while len(rules) < population:
                u = self.random.random()
                rules.append(self.mutate(self.random.choice(keep)) if u < 0.4 else self.cross(*self.random.choices(keep, k=2)) if u < 0.8 else self.rule())
        return [best, *[x for x in ranked[:elite] if x is not best]]
