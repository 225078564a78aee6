"""Resolved view definitions."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

FORMAT = 2


@dataclass(frozen=True)
class ColumnRef:
    """A column by side (0 or 1 of the FROM clause) and declared name."""

    side: int
    name: str


@dataclass(frozen=True)
class Aggregate:
    """kind: count_star, count, sum, total, avg, min or max."""

    kind: str
    column: ColumnRef | None
    output: str


@dataclass(frozen=True)
class Predicate:
    """One column against a literal, or a NULL test. literal: (class, value) with class int, real, text or blob; a blob is hex."""

    column: ColumnRef
    op: str
    literal: tuple[str, object] | None = None


@dataclass(frozen=True)
class ViewSpec:
    """What a view computes; tables and names as declared."""

    tables: tuple[str, ...]
    keys: tuple[tuple[ColumnRef, str], ...]
    aggregates: tuple[Aggregate, ...]
    predicate: Predicate | None = None
    join: tuple[ColumnRef, ColumnRef] | None = None
    sql: str = field(default="", compare=False)

    def fingerprint(self) -> str:
        plan = asdict(self)
        plan.pop("sql")
        return hashlib.sha256(json.dumps([FORMAT, plan], sort_keys=True, default=str).encode()).hexdigest()

    @property
    def outputs(self) -> list[str]:
        return [n for _, n in self.keys] + [a.output for a in self.aggregates]
