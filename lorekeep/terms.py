"""Terms of questions: variables, comparison operators, patterns and frames."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Op:
    """A comparison with a constant that may also bind the value it tests: gt(5, "?x")."""

    name: str
    value: Any
    var: str | None = None

    def test(self, column: Column) -> Column:
        tests: dict[str, Callable[[], Column]] = {
            "eq": lambda: column == self.value, "neq": lambda: column != self.value, "lt": lambda: column < self.value, "gt": lambda: column > self.value,
            "leq": lambda: column <= self.value, "geq": lambda: column >= self.value, "in": lambda: column.isin(list(self.value)),
            "nin": lambda: ~column.isin(list(self.value)), "prefix": lambda: column.startswith(self.value), "regex": lambda: column.rlike(self.value),
        }
        return tests[self.name]()


def _op(name: str) -> Callable[..., Op]:
    return lambda value, var=None: Op(name, tuple(value) if name in ("in", "nin") else value, var)


eq, neq, lt, gt, leq, geq, in_, nin, prefix, regex = map(_op, ("eq", "neq", "lt", "gt", "leq", "geq", "in", "nin", "prefix", "regex"))


def is_var(term: Any) -> bool:
    return isinstance(term, str) and term.startswith("?")


@dataclass(frozen=True)
class Frame:
    """What a fact must satisfy: named graphs, whose perspective, how certain, and when.

    No agent means facts of one's own. Uncertain facts count only if ``uncertain`` is set; then at least ``confidence``,
    where it is known. An interval asks that the fact holds throughout it (always), or in some part (``occasional``).
    """

    graphs: tuple[str, ...] = ()
    agent: str | None = None
    uncertain: bool = False
    confidence: float | None = None
    occasional: bool = False
    begin: float | None = None
    end: float | None = None

    def condition(self, columns: dict[str, Column], graphs: tuple[str, ...] | None = None) -> Column:
        """The filter; ``columns`` may lack fields of the frame, which then are as if unset."""
        unset = {"graph": F.lit(None).cast("string"), "agent": F.lit(None).cast("string"), "uncertain": F.lit(False), "confidence": F.lit(None).cast("double"), "occasional": F.lit(False), "begin": F.lit(None).cast("double"), "end": F.lit(None).cast("double")}
        c = unset | columns
        test = c["agent"].eqNullSafe(F.lit(self.agent))
        if names := graphs if graphs is not None else self.graphs:
            test &= c["graph"].isin(list(names))
        test &= F.lit(True) if self.uncertain else ~F.coalesce(c["uncertain"], F.lit(False))
        if self.confidence is not None:
            test &= c["confidence"].isNull() | (c["confidence"] >= self.confidence)
        begin, end = F.coalesce(c["begin"], F.lit(-math.inf)), F.coalesce(c["end"], F.lit(math.inf))
        if self.begin is not None or self.end is not None:
            b = self.begin if self.begin is not None else -math.inf
            e = self.end if self.end is not None else math.inf
            test &= (begin <= e) & (end >= b) if self.occasional else (begin <= b) & (end >= e)
        return test if self.occasional else test & ~F.coalesce(c["occasional"], F.lit(False))


def _nested(frame: Frame, agent: str | None) -> None:
    if frame.agent and agent != frame.agent:
        raise ValueError(f"what {frame.agent} knows of another's mind isn't stored")


def know(frame: Frame = Frame(), agent: str | None = None) -> Frame:
    """K: what the agent knows; a frame inside another adds to it. Another agent's view inside an agent's is an error."""
    _nested(frame, agent or frame.agent)
    return replace(frame, agent=agent or frame.agent, uncertain=False)


def believe(frame: Frame = Frame(), agent: str | None = None, confidence: float | None = None) -> Frame:
    """B: what the agent believes with the confidence at least."""
    _nested(frame, agent or frame.agent)
    return replace(frame, agent=agent or frame.agent, uncertain=True, confidence=confidence)


def sometimes(frame: Frame = Frame(), begin: float | None = None, end: float | None = None) -> Frame:
    """P: at some time in the interval."""
    return replace(frame, occasional=True, begin=begin, end=end)


def always(frame: Frame = Frame(), begin: float | None = None, end: float | None = None) -> Frame:
    """H: throughout the interval."""
    return replace(frame, occasional=False, begin=begin, end=end)


def at(time: float, frame: Frame = Frame()) -> Frame:
    """What holds at a time: the scope of a question without one is ``at(now)``."""
    return always(frame, time, time)


@dataclass(frozen=True)
class Pattern:
    """A fact with variables ("?x"), constants or operators for subject and object; the predicate is a name or a variable."""

    s: Any
    p: str
    o: Any
    frame: Frame = field(default_factory=Frame)

    def variables(self) -> list[str]:
        found = [t.var if isinstance(t, Op) else t for t in (self.s, self.p, self.o)]
        return [t[1:] for t in dict.fromkeys(found) if t and is_var(t)]
