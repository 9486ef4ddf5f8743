"""Custom propagation rules: trigger and action expressions compiled to columns.

A trigger is terms joined by OR, each of conditions joined by AND: `has_label(x)`, `has_dependency(x)`,
`strength > 0.5`, `hops <= 3`, `type == "label"`. An action is `multiply_strength(f)`, `multiply_decay(f)` (which
acts on the strength), `add_strength(a)` or `set_strength(v)`. All triggers look at the state as it was; actions are
done in the rules' order.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt}
_CALL = re.compile(r"(\w+)\(\s*[\"']?(.*?)[\"']?\s*\)")
_TEST = re.compile(r"(strength|hops|type)\s*(>=|<=|==|!=|>|<)\s*[\"']?(.*?)[\"']?")


@dataclass(frozen=True)
class Rule:
    name: str
    trigger: str
    action: str


def condition(text: str) -> Column:
    """One condition over columns strength, hops, type, labels and dependencies."""
    text = text.strip()
    call = _CALL.fullmatch(text)
    if call and call[1] in ("has_label", "has_dependency"):
        return F.array_contains("labels" if call[1] == "has_label" else "dependencies", call[2])
    test = _TEST.fullmatch(text)
    if not test:
        raise ValueError(f"not a condition: {text}")
    if test[1] == "type" and test[2] not in ("==", "!="):
        raise ValueError(f"a type is equal or not: {text}")
    return _COMPARE[test[2]](F.col(test[1]), F.lit(test[3] if test[1] == "type" else float(test[3])))


def trigger(text: str) -> Column:
    terms = [reduce(operator.and_, map(condition, term.split(" AND "))) for term in text.split(" OR ")]
    return reduce(operator.or_, terms)


def action(text: str, strength: Column) -> Column:
    call = _CALL.fullmatch(text.strip())
    acts = {"multiply_strength": operator.mul, "multiply_decay": operator.mul, "add_strength": operator.add, "set_strength": lambda _, v: v}
    if not call or call[1] not in acts:
        raise ValueError(f"not an action: {text}")
    return acts[call[1]](strength, F.lit(float(call[2])))


def parse(text: str) -> list[Rule]:
    """Rules of a text: `name: trigger -> action` lines; blank lines and `#` comments are left out."""
    out = []
    for line in text.splitlines():
        if line.strip() and not line.strip().startswith("#"):
            name, _, rest = line.partition(":")
            when, arrow, then = rest.partition("->")
            if not arrow:
                raise ValueError(f"not a rule: {line}")
            out.append(Rule(name.strip(), when.strip(), then.strip()))
    return out


def _asked(rules: list[Rule], call: str) -> list[str]:
    return sorted({m[2] for r in rules for m in _CALL.finditer(r.trigger) if m[1] == call})


def applied(state: DataFrame, rules: list[Rule], labels: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The state (id, type, attribute, strength, hops) after the rules. labels: id, label; dependencies: id,
    dependency; of both only what the rules ask about is looked up."""
    rows = state
    for name, held, call in (("label", labels, "has_label"), ("dependency", dependencies, "has_dependency")):
        asked = _asked(rules, call)
        column = "labels" if name == "label" else "dependencies"
        if asked:
            own = held.where(F.col(name).isin(asked)).groupBy("id").agg(F.collect_set(name).alias(column))
            rows = rows.join(own, "id", "left")
        else:
            rows = rows.withColumn(column, F.lit(None).cast("array<string>"))
    fired = [F.coalesce(trigger(r.trigger), F.lit(False)) for r in rules]
    strength = F.col("strength")
    for r, on in zip(rules, fired, strict=True):
        strength = F.when(on, action(r.action, strength)).otherwise(strength)
    return rows.select("id", "type", "attribute", strength.alias("strength"), "hops", F.array_compact(F.array(*[F.when(on, F.lit(r.name)) for r, on in zip(rules, fired, strict=True)])).alias("fired"))
