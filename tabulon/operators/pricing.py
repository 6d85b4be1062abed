"""Repricing: plans over items, the change report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import MONEY, apply_rule, auto_step, pct_change, round_step
from ..plans.commands import Plan


def chosen_rule(plan: Plan, group: Column, item: Column) -> Column:
    """JO13, AG3, QL3: struct(ord, op, operand) of the last rule whose scope has the item, or null. A plan is a line of
    text, so its rules are folded into the projection: no join, no shuffle."""
    out = F.lit(None).cast("struct<ord:int,op:string,operand:decimal(12,4)>")
    for n, rule in enumerate(plan.rules):
        scope = F.lit(True)
        if rule.groups is not None:
            scope = group.isin(*sorted(rule.groups)) if rule.groups else F.lit(False)
        elif rule.ids is not None:
            scope = item.isin(*sorted(rule.ids)) if rule.ids else F.lit(False)
        it = F.struct(F.lit(n).alias("ord"), F.lit(rule.op).alias("op"), F.lit(str(rule.value)).cast("decimal(12,4)").alias("operand"))
        out = F.when(scope, it).otherwise(out)
    return out


def join_rules(items: DataFrame, rules: DataFrame, item: str = "id", group: str = "grp") -> DataFrame:
    """JO13, AG3 for large rule tables (ord, scope, ids, groups, op, operand): scopes are exploded to equi keys, so that
    no rule meets every item; the last of an item's rules wins. Rules for all keep only the last of them."""
    key = lambda c, k: rules.where(F.col("scope") == k).select(F.explode(c).alias("_k"), F.struct("ord", "op", "operand").alias("_r"))
    best = lambda df: df.groupBy("_k").agg(F.max("_r").alias("_r"))
    by_id, by_group = best(key("ids", "ids")), best(key("groups", "groups"))
    for_all = rules.where("scope = 'all'").agg(F.max(F.struct("ord", "op", "operand")).alias("_a"))  # one row
    out = items.join(by_id.select(F.col("_k").alias(item), F.col("_r").alias("_i")), item, "left")
    out = out.join(by_group.select(F.col("_k").alias(group), F.col("_r").alias("_g")), group, "left").crossJoin(F.broadcast(for_all))
    return out.withColumn("rule", F.greatest("_i", "_g", "_a")).drop("_i", "_g", "_a")


def new_value(value: Column, decimals: Column, op: Column, operand: Column, step: Column, mode: str) -> Column:
    """MA3, MA4: the rule, then the step, then the item's own decimals, never below 0."""
    raw = apply_rule(op, operand, value)
    step = F.when(step < 0, auto_step(value, decimals)).otherwise(step)
    stepped = round_step(raw, step, F.lit(mode))
    power = F.pow(F.lit(10), decimals).cast("decimal(6,0)")
    fine = F.round((stepped * power).cast("decimal(30,4)"), 0)
    out = (fine.cast("decimal(28,0)") * F.element_at(F.array(*(F.lit(x).cast("decimal(5,4)") for x in ("1", "0.1", "0.01", "0.001", "0.0001"))), decimals + 1)).cast(MONEY)
    return F.greatest(out, F.lit(0).cast(MONEY))


def compute(items: DataFrame, plan: Plan, item: str = "id", group: str = "grp") -> DataFrame:
    """JO12, QL6: items (id, grp, value, decimals, ...) whose price changes, with `new`. Null values never change."""
    step = F.lit(str(plan.step)).cast("decimal(18,4)")
    out = items.withColumn("_r", chosen_rule(plan, F.col(group), F.col(item).cast("string"))).where("_r is not null")
    out = out.withColumn("new", new_value(F.col("value").cast(MONEY), F.col("decimals"), F.col("_r.op"), F.col("_r.operand"), step, plan.mode))
    return out.where(F.col("new") != F.col("value").cast(MONEY)).drop("_r")


def change_report(changes: DataFrame) -> DataFrame:
    """SK4: group, label, old, new and relative change of each item that changes."""
    return changes.select("id", "grp", "label", F.col("value").cast("decimal(18,2)").alias("old"), F.col("new").cast("decimal(18,2)").alias("new"), F.round(pct_change(F.col("value"), F.col("new")), 6).alias("pct"))


def namespaced(items: DataFrame, file_no: str = "file_no", scoped: bool = True) -> DataFrame:
    """QL6: ids of several files told apart by f{n}-, where a rule is scoped to ids."""
    return items.withColumn("id", F.concat(F.lit("f"), F.col(file_no), F.lit("-"), F.col("id"))) if scoped else items
