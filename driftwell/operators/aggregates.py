"""Grouped aggregates with retraction: state from weighted rows, merged state, and output.

State of a view is one table, keyed by the canonical group key k0, k1, .. and, where the view needs more than counters, by
the sort of entry p:

    p = 0      the group: rows, k<i>_real (rows whose dynamic key was a real), and per column that is counted or summed
               c<j>_n (not NULL), c<j>_int (sum of integers, decimal(38,0)), c<j>_apx (reals), c<j>_pos, c<j>_neg (infinities)
    p = 1      col, k, m: buckets of the real sums (functions.exact)
    p = 2 + j  v<j>, w: the multiset of values of column j under MIN or MAX

Entries add up: state of all rows = merge(state of some rows, state of the others), with negative weights for rows removed.
One scan and one shuffle make all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions import exact, values
from driftwell.operators.zset import W
from driftwell.plans.viewspec import Aggregate, ColumnRef, ViewSpec

_COUNTERS = ("n", "int", "apx", "pos", "neg")


@dataclass(frozen=True)
class Layout:
    """How a view's columns lie in its state: kinds of keys and inputs, and which inputs are counted, summed or ordered."""

    spec: ViewSpec
    key_kinds: tuple[str, ...]
    columns: tuple[ColumnRef, ...]
    kinds: tuple[str, ...]
    types: tuple[T.DataType, ...]

    @classmethod
    def of(cls, spec: ViewSpec, schemas: list[T.StructType]) -> Layout:
        field = lambda ref: schemas[ref.side][ref.name]
        columns = tuple(dict.fromkeys(a.column for a in spec.aggregates if a.column is not None))
        kinds = tuple(values.kind_of(field(c).dataType) for c in columns)
        return cls(spec, tuple(values.kind_of(field(k).dataType) for k, _ in spec.keys), columns, kinds, tuple(field(c).dataType for c in columns))

    @property
    def keys(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.key_kinds))]

    def _using(self, *kinds: str) -> list[int]:
        return [j for j, c in enumerate(self.columns) if any(a.column == c and a.kind in kinds for a in self.spec.aggregates)]

    @property
    def counted(self) -> list[int]:
        return self._using("count", "sum", "total", "avg")

    @property
    def summed(self) -> list[int]:
        return self._using("sum", "total", "avg")

    @property
    def real(self) -> list[int]:
        return [j for j in self.summed if self.kinds[j] not in ("int", "bool")]

    @property
    def ordered(self) -> list[int]:
        return self._using("min", "max")

    @property
    def sorts(self) -> bool:
        """Whether there are entries besides those of groups."""
        return bool(self.real or self.ordered)

    @property
    def entry(self) -> list[str]:
        """Columns that identify an entry of the state."""
        return [*self.keys, *(["p"] if self.sorts else []), *(["col", "k"] if self.real else []), *[f"v{j}" for j in self.ordered]]

    @property
    def sums(self) -> list[str]:
        """Columns of the state that add up."""
        return [*self.additive, *(["m"] if self.real else []), *(["w"] if self.ordered else [])]

    def counters(self, j: int) -> list[str]:
        wanted = _COUNTERS if j in self.real else _COUNTERS[:2] if j in self.summed else _COUNTERS[:1]
        return [f"c{j}_{x}" for x in wanted]

    @property
    def additive(self) -> list[str]:
        """Columns of groups that add up."""
        real_keys = [f"k{i}_real" for i, kind in enumerate(self.key_kinds) if kind == "dyn"]
        return ["rows", *real_keys, *[c for j in self.counted for c in self.counters(j)]]


def _exact_product(value: Column, weight: Column) -> Column:
    return (value.cast("decimal(20,0)") * weight.cast("decimal(18,0)")).cast("decimal(38,0)")


def _added(value: Column) -> Column:
    return F.sum(value).cast("decimal(38,0)")


def _summed(columns: list[str]) -> list[Column]:
    return [(_added(F.col(c)) if c.endswith("_int") or c == "m" else F.sum(c)).alias(c) for c in columns]


def partial(layout: Layout, rows: DataFrame) -> DataFrame:
    """State of weighted rows with columns k<i> (raw keys), v<j> (inputs) and _w."""
    keys = [values.canonical(F.col(k), kind).alias(k) for k, kind in zip(layout.keys, layout.key_kinds)]
    given = [F.col(k)["c"].alias(f"x{i}") for i, (k, kind) in enumerate(zip(layout.keys, layout.key_kinds)) if kind == "dyn"]
    prepared = []
    for j in sorted(set(layout.counted) | set(layout.ordered)):
        prepared.append(F.col(f"v{j}"))
        if j in layout.summed:
            whole, real = values.number_parts(F.col(f"v{j}"), layout.kinds[j])
            prepared += [whole.alias(f"i{j}"), real.alias(f"r{j}")] + ([exact.exponent(real).alias(f"e{j}")] if j in layout.real else [])
    base = rows.select(*keys, *given, *prepared, W)
    w, zero, nothing = F.col(W), F.lit(0).cast("bigint"), F.lit(0).cast("decimal(38,0)")
    made = {"rows": w} | {f"k{i}_real": F.when(F.col(f"x{i}") == values.REAL, w).otherwise(zero) for i, kind in enumerate(layout.key_kinds) if kind == "dyn"}
    for j in layout.counted:
        made[f"c{j}_n"] = F.when(~values.is_null(F.col(f"v{j}"), layout.kinds[j]), w).otherwise(zero)
        if j in layout.summed:
            made[f"c{j}_int"] = F.when(F.col(f"i{j}").isNotNull(), _exact_product(F.col(f"i{j}"), w)).otherwise(nothing)
        if j in layout.real:
            r = F.col(f"r{j}")
            made |= {f"c{j}_apx": F.when(r.isNotNull(), w).otherwise(zero), f"c{j}_pos": F.when(r == float("inf"), w).otherwise(zero), f"c{j}_neg": F.when(r == float("-inf"), w).otherwise(zero)}
    if not layout.sorts:
        return base.select(*layout.keys, *[c.alias(n) for n, c in made.items()]).groupBy(*layout.keys).agg(*_summed(layout.additive))
    types = {n: "decimal(38,0)" if n.endswith("_int") or n == "m" else "bigint" for n in layout.sums} | {"p": "int", "col": "int", "k": "int"}
    kinds = {f"v{j}": base.schema[f"v{j}"].dataType for j in layout.ordered}
    names = [n for n in [*layout.entry, *layout.sums] if n not in layout.keys]

    def entry(p: int, **held: Column) -> Column:
        return F.struct(*[held.get(n, F.lit(p) if n == "p" else F.lit(None)).cast(kinds.get(n) or types[n]).alias(n) for n in names])

    entries = [entry(0, **made)]
    for j in layout.real:
        e = F.col(f"e{j}")
        entries.append(entry(1, col=F.lit(j), k=exact.bucket(e), m=(exact.mantissa(F.col(f"r{j}"), e) * w.cast("decimal(18,0)")).cast("decimal(38,0)")))
    for j in layout.ordered:
        there = ~values.is_null(F.col(f"v{j}"), layout.kinds[j])
        entries.append(entry(2 + j, **{f"v{j}": F.when(there, F.col(f"v{j}")), "w": F.when(there, w)}))
    used = F.col("p") == 0
    if layout.real:
        used = used | F.col("m").isNotNull()
    if layout.ordered:
        used = used | F.col("w").isNotNull()
    spread = base.select(*layout.keys, F.inline(F.array(*entries))).where(used)
    return spread.groupBy(*layout.entry).agg(*_summed(layout.sums))


def merge(layout: Layout, state: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """Entries of *state* added up (per *beside*, columns it has besides); entries that have come to nothing are dropped."""
    return living(layout, state.groupBy(*beside, *layout.entry).agg(*_summed(layout.sums)))


def living(layout: Layout, state: DataFrame) -> DataFrame:
    """Entries that are not nothing."""
    left = F.lit(False)
    for c in layout.sums:
        left = left | (F.coalesce(F.col(c), F.lit(0)) != 0)
    return state.where(left)


def _output(layout: Layout, a: Aggregate) -> Column:
    if a.kind == "count_star":
        return F.col("rows")
    j = layout.columns.index(a.column)
    kind = layout.kinds[j]
    if a.kind == "count":
        return F.col(f"c{j}_n")
    if a.kind in ("min", "max"):
        found = F.col(f"{a.kind}{j}")
        return F.coalesce(found, values.int_cell(F.lit(None).cast("bigint"))) if kind == "dyn" else found
    n, whole = F.col(f"c{j}_n"), F.col(f"c{j}_int")
    none = F.lit(None).cast("double")
    one = F.lit(1).cast("bigint")
    if j in layout.real:
        infinite = F.when((F.col(f"c{j}_pos") > 0) & (F.col(f"c{j}_neg") > 0), none).when(F.col(f"c{j}_pos") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        finite = (F.col(f"c{j}_pos") == 0) & (F.col(f"c{j}_neg") == 0)
        buckets, at_once = F.col(f"buckets{j}"), F.col(f"quick{j}")
        slow = lambda count: exact.rounded(whole, buckets["k"], buckets["m"], count)
        real = lambda count: F.when(finite, F.coalesce(at_once, slow(F.when(at_once.isNull(), count))) if count is one else slow(count)).otherwise(infinite)
    else:
        no_k, no_m = F.lit(None).cast("array<int>"), F.lit(None).cast("array<decimal(38,0)>")
        small = (F.abs(whole) <= 2**53) & (n <= 2**53)  # both are doubles as they are: their quotient is rounded once
        mean = lambda count: F.when(small, whole.cast("double") / count.cast("double")).otherwise(exact.rounded(whole, no_k, no_m, F.when(~small, count)))
        real = lambda count: whole.cast("double") if count is one else mean(count)
    if a.kind == "total":
        return F.when(n > 0, real(one)).otherwise(F.lit(0.0)) if j not in layout.real else F.when(n == 0, F.lit(0.0)).otherwise(real(one))
    if a.kind == "avg":
        return F.when(n > 0, real(n))
    if j not in layout.real:
        return F.when(n > 0, whole.try_cast("bigint"))
    if kind == "dyn":
        as_int = values.int_cell(whole.try_cast("bigint"))
        null = values.int_cell(F.lit(None).cast("bigint"))
        return F.when(n == 0, null).when(F.col(f"c{j}_apx") == 0, as_int).otherwise(F.coalesce(values.real_cell(real(one)), null))
    return F.when(n > 0, real(one))


def finalize(layout: Layout, state: DataFrame, beside: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(groups of merged *state* per key, what turns them into output rows). Groups without rows are among them, for group_faults()."""
    made = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in layout.additive]
    at = F.col("p") if layout.sorts else None
    if layout.real:
        made += [F.array_sort(F.collect_list(F.when((at == 1) & (F.col("col") == j) & (F.col("m") != 0), F.struct("k", "m")))).alias(f"buckets{j}") for j in layout.real]
    for j in layout.ordered:
        held = F.when((at == 2 + j) & (F.col("w") > 0), F.col(f"v{j}"))
        if layout.kinds[j] == "dyn":
            by = F.when(held.isNotNull(), values.sort_key(F.col(f"v{j}"), "dyn"))
            made += [F.min_by(held, by).alias(f"min{j}"), F.max_by(held, by).alias(f"max{j}")]
        else:
            made += [F.min(held).alias(f"min{j}"), F.max(held).alias(f"max{j}")]
    if layout.sorts:
        made.append(F.count(F.when(at != 0, True)).alias("others"))
    grouped = state.groupBy(*beside, *layout.keys).agg(*made)

    def output(groups: DataFrame) -> DataFrame:
        keys = [values.key_output(F.col(k), kind, F.col(f"{k}_real") if kind == "dyn" else F.lit(0)).alias(name) for k, kind, (_, name) in zip(layout.keys, layout.key_kinds, layout.spec.keys)]
        groups = groups.where(F.col("rows") > 0)
        for j in layout.real:
            groups = exact.with_quick(groups, f"quick{j}", f"c{j}_int", f"buckets{j}")
        return groups.select(*beside, *keys, *[_output(layout, a).alias(a.output) for a in layout.spec.aggregates])

    return grouped, output


def entry_faults(layout: Layout) -> dict[str, Column]:
    """Conditions of impossible entries of a merged state, by the message each stands for."""
    group = F.col("p") == 0 if layout.sorts else F.lit(True)
    bad = F.col("rows") <= 0
    for j in layout.counted:
        bad = bad | (F.col(f"c{j}_n") < 0) | (F.col(f"c{j}_n") > F.col("rows"))
    found = {"a group with fewer rows than none: a row was removed that is not there": group & bad}
    for j in layout._using("sum"):
        only_int = F.lit(True) if j not in layout.real else (F.col(f"c{j}_apx") == 0) if layout.kinds[j] == "dyn" else F.lit(False)
        over = (F.col(f"c{j}_int") > F.lit(2**63 - 1)) | (F.col(f"c{j}_int") < F.lit(-(2**63)))
        found[f"integer overflow in SUM({layout.columns[j].name})"] = group & only_int & over
    if layout.ordered:
        found["a value under MIN or MAX was removed that is not there"] = F.coalesce(F.col("w") < 0, F.lit(False))
    return found


def group_faults(layout: Layout) -> dict[str, Column]:
    """Conditions of groups whose entries contradict each other: something is left where nothing was counted."""
    if not layout.sorts:
        return {}
    found = {"a group without rows has values left": (F.col("rows") == 0) & (F.col("others") > 0)}
    for j in layout.real:
        finite = F.col(f"c{j}_apx") - F.col(f"c{j}_pos") - F.col(f"c{j}_neg")
        found[f"the sum of {layout.columns[j].name} has a residue without values"] = (finite == 0) & (F.size(f"buckets{j}") > 0)
    return found
