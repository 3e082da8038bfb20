"""Child rules: a predicate language, evaluated early where data isn't needed, and compiled to Columns.

A rule is nested dicts: {"all": [...]}, {"any": [...]}, {"not": rule}, {"always": bool}, {"entry_type": t},
{"external_type": t}, {"name": regex}, {"url": regex}, {"duration": [min, max)}, {"index": [min, max)},
{"has_source": s}, {"appears_on": s}, {"field": [name, value]}, and over children
{"children": {"count" | "ratio": [min, max], "match": rule}} with both ends inclusive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cheapest first; conjunctions and disjunctions ask in this order.
COST = {"always": 0, "entry_type": 1, "external_type": 1, "index": 1, "duration": 2, "field": 2, "has_source": 5, "appears_on": 5, "name": 20, "url": 20, "children": 100}


def cost(rule: dict) -> int:
    (op, arg), = rule.items()
    if op in ("all", "any"):
        return sum(map(cost, arg))
    return cost(arg) if op == "not" else COST[op]


def fold(rule: dict, known: dict) -> bool | None:
    """The rule's value, if what is known (entry_type, external_type) decides it: Kleene's three values."""
    (op, arg), = rule.items()
    if op == "always":
        return bool(arg)
    if op == "not":
        inner = fold(arg, known)
        return None if inner is None else not inner
    if op in ("all", "any"):
        stop = op == "any"
        seen = [fold(r, known) for r in arg]
        return stop if stop in seen else None if None in seen else not stop
    return known[op] == arg if op in ("entry_type", "external_type") and op in known else None


def simplify(rule: dict, known: dict) -> dict:
    """The rule without the parts that are decided."""
    value = fold(rule, known)
    if value is not None:
        return {"always": value}
    (op, arg), = rule.items()
    if op == "not":
        return {"not": simplify(arg, known)}
    if op in ("all", "any"):
        left = sorted((simplify(r, known) for r in arg if fold(r, known) is None), key=cost)
        return left[0] if len(left) == 1 else {op: left}
    return rule


def last_index(rule: dict) -> int | None:
    """The least position from which on no child can match, if the rule bounds it."""
    (op, arg), = rule.items()
    if op == "index":
        return arg[1]
    if op == "all":
        ends = [e for e in map(last_index, arg) if e is not None]
        return min(ends) if ends else None
    if op == "any":
        ends = [last_index(r) for r in arg]
        return max(ends) if ends and None not in ends else None
    return None


def compile_rule(rule: dict, quantified: dict[str, Column] | None = None) -> Column:
    """A Column over entry_type, external_type, name, url, duration_ms, position, sources, appears_on and fields."""
    (op, arg), = rule.items()
    if op == "always":
        return F.lit(bool(arg))
    if op == "not":
        return ~compile_rule(arg, quantified)
    if op in ("all", "any"):
        parts = [compile_rule(r, quantified) for r in sorted(arg, key=cost)]
        return reduce(lambda x, y: x & y if op == "all" else x | y, parts, F.lit(op == "all"))
    if op in ("entry_type", "external_type"):
        return F.coalesce(F.col(op) == arg, F.lit(False))
    if op in ("name", "url"):
        return F.coalesce(F.col(op).rlike(arg), F.lit(False))
    if op in ("duration", "index"):
        c, (low, high) = F.col("duration_ms" if op == "duration" else "position"), arg
        test = F.lit(True) if low is None else c >= low
        return F.coalesce(test if high is None else test & (c < high), F.lit(False)) & c.isNotNull()
    if op in ("has_source", "appears_on"):
        return F.coalesce(F.array_contains("sources" if op == "has_source" else "appears_on", arg), F.lit(False))
    if op == "field":
        return F.coalesce(F.get_json_object("fields", f"$.{arg[0]}") == str(arg[1]), F.lit(False))
    if op == "children":
        return quantified[repr(rule)]
    raise ValueError(f"unknown rule: {op}")


def quantifiers(rule: dict) -> list[dict]:
    (op, arg), = rule.items()
    if op == "children":
        return [rule]
    inner = [arg] if op == "not" else arg if op in ("all", "any") else []
    return [q for r in inner for q in quantifiers(r)]


def _quantified(rule: dict, hits: Column, total: Column) -> Column:
    spec = rule["children"]
    if "count" in spec:
        low, high = spec["count"]
        test = hits >= (low or 0)
        return test if high is None else test & (hits <= high)
    low, high = spec["ratio"]
    share = hits / total
    test = share >= (low or 0.0)
    # no children: no ratio holds
    return F.when(total == 0, False).otherwise(test if high is None else test & (share <= high))


def first_match(entries: DataFrame, rules: list[tuple[str, dict]], children: DataFrame | None = None) -> DataFrame:
    """entries with `action`: that of the first rule that matches, or null. children: parent_id and the columns of rules;
    their quantified parts are one grouped pass, joined on entry_id."""
    asked = {repr(q): q for _, r in rules for q in quantifiers(r)}
    wide, columns = entries, {}
    if asked:
        sums = [F.sum(compile_rule(q["children"]["match"]).cast("int")).alias(f"__hits{i}") for i, q in enumerate(asked.values())]
        counts = children.groupBy(F.col("parent_id").alias("entry_id")).agg(F.count("*").alias("__total"), *sums)
        wide = entries.join(counts, "entry_id", "left").na.fill(0, ["__total", *(f"__hits{i}" for i in range(len(asked)))])
        columns = {key: _quantified(q, F.col(f"__hits{i}"), F.col("__total")) for i, (key, q) in enumerate(asked.items())}
    action = F.coalesce(*[F.when(compile_rule(r, columns), F.lit(name)) for name, r in rules], F.lit(None).cast("string"))
    return wide.withColumn("action", action).select(*entries.columns, "action")
