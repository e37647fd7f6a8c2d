"""Coding rules as data (D5, D7): ordered condition tables, compiled to one column expression each.

A rule table is a list of rules ``(tests, value)`` with a default; the first rule whose tests all
hold gives the value, as in ``case_when``. Tests and values are plain tuples, so a pilot's coding is
a table and not code:

* ``("missing", column, ...)`` — all these columns are null, or hold one of the table's ``missing`` texts;
* ``("is", column, value)``    — the column equals a value; the column may be one coded before;
* value ``("text", t)`` or ``("column", name)`` or ``None``; ``cast`` converts the chosen value.

``code`` compiles the tables in order: later tables may test the results of earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions import scalars as X
from trialstats.plans.trials import code_switches

Test = tuple[Any, ...]
Value = tuple[str, str] | None


@dataclass(frozen=True)
class RuleTable:
    """The rules of one coded column."""

    out: str
    rules: Sequence[tuple[Sequence[Test], Value]]
    default: Value = None
    cast: str = "string"
    missing: Sequence[str] = ("",)

    def _present(self, column: str) -> Column:
        c = F.col(column)
        for text in self.missing:
            c = F.nullif(c, F.lit(text))
        return c

    def _test(self, test: Test) -> Column:
        kind, *args = test
        if kind == "missing":
            return X.all_null([self._present(c) for c in args])
        if kind == "is":
            return F.col(args[0]) == F.lit(args[1])
        raise ValueError(f"unknown test {kind!r} of {self.out!r}")

    def _value(self, value: Value) -> Column:
        if value is None:
            return F.lit(None).cast(self.cast)
        kind, what = value
        if kind not in ("text", "column"):
            raise ValueError(f"unknown value {kind!r} of {self.out!r}")
        return (F.lit(what) if kind == "text" else self._present(what)).cast(self.cast)

    def expression(self) -> Column:
        chosen = None
        for tests, value in self.rules:
            holds = self._test(tests[0])
            for t in tests[1:]:
                holds = holds & self._test(t)
            chosen = F.when(holds, self._value(value)) if chosen is None else chosen.when(holds, self._value(value))
        default = self._value(self.default)
        return default if chosen is None else chosen.otherwise(default)


def code(df: DataFrame, tables: Sequence[RuleTable]) -> DataFrame:
    """Add the coded column of each table, in order."""
    for t in tables:
        df = df.withColumn(t.out, t.expression())
    return df


# ----------------------------------------------------------------------------------
# The rules of pilots 2 and 3 (two counterbalances). The loc keys are tested first, so a trial
# without any response counts as shape.
def _key(task: str, cb: int, field: str = "keys") -> str:
    return f"both_{task}_cb{cb}_{field}"


def _by_task(out: str, field: str, default: Value, cast: str = "string") -> RuleTable:
    """The field of the counterbalance whose counterpart has no key, shape before loc and the first counterbalance tested first."""
    rules = [([("is", "task_perf", task), ("missing", _key(task, empty))], ("column", _key(task, 3 - empty, field)))
             for task in ("shape", "loc") for empty in (1, 2)]
    return RuleTable(out, rules, default, cast)


PILOT_2 = (
    RuleTable("task_perf", [([("missing", _key("loc", 1), _key("loc", 2))], ("text", "shape")),
                            ([("missing", _key("shape", 1), _key("shape", 2))], ("text", "loc"))], ("text", "unknownTask")),
    _by_task("resp", "keys", ("text", "unknownResp")),
    _by_task("corr", "corr", ("text", "unknownCorr")),
    _by_task("rt", "rt", None, "double"),
)
# ----------------------------------------------------------------------------------


def trials_pilot2(logs: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Pilots 2-3: coded task, response, accuracy and time; the switch across blocks (``unknownSwitch`` where unclear); rows with
    unknown accuracy (999) or none dropped after that. logs: ``id``, the order columns and the one-hot columns, as text."""
    coded = code(logs, PILOT_2).select("id", *order, *[t.out for t in PILOT_2])
    coded = code_switches(coded, keys=("id",), order=order, unknown="unknownSwitch")
    return coded.where(F.col("corr") != "999")
