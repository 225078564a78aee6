"""The view engine: base tables with captured changes, and views that are refreshed from the changes only.

    engine = Engine(spark, "/shared/views")
    engine.create_table("orders", orders_df)
    engine.create_view("revenue", "SELECT region, SUM(amount), COUNT(*) FROM orders GROUP BY region")
    engine.insert("orders", new_rows)
    engine.refresh("revenue")
    engine.table("revenue").show()

At every refresh the view equals its query over the base tables. Reads never refresh. State and output are kept in hash
buckets of the group key, each a list of runs that add up: a refresh appends one run of its changes to the buckets it touches,
reads the state of those buckets only, and works out the touched groups only. Buckets with many runs are merged into one. A
join view keeps both sides as well, in hash buckets of the join key, so that changes of one side meet the matching buckets
of the other instead of its whole table. Everything a refresh does becomes visible in one commit.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions import values
from driftwell.operators import zset
from driftwell.operators.aggregates import Layout, entry_faults, finalize, group_faults, living, merge, partial
from driftwell.operators.zset import W
from driftwell.plans.errors import BrokenView, IllegalChange, StateError, SumOverflow, UnknownTable, UnsupportedView, ViewError
from driftwell.plans.sqlfront import PREFIX, parse_view
from driftwell.plans.store import Store
from driftwell.plans.viewspec import FORMAT, Predicate, ViewSpec
from driftwell.session import input_bytes, slots, stored_bytes, with_package, work_path
from driftwell.sources import changelog

#: Views refresh_all works on side by side.
VIEWS_AT_ONCE = 8
#: Runs of a bucket beyond which they are merged into one.
MAX_RUNS = 8
#: Stored bytes of a bucket aimed at; state that has grown beyond several times that is cut anew when runs are merged.
BUCKET_BYTES = 64 << 20
#: Stored bytes up to which changes are broadcast; beyond, Spark chooses.
SMALL_DELTA = 8 << 20
_SUMMABLE = ("int", "bool", "real", "decimal", "text", "blob", "dyn")


def literal_condition(predicate: Predicate, field: T.StructField) -> Column | None:
    """The predicate as a condition; the literal is converted by the column's affinity first, never the column."""
    kind, affinity = values.kind_of(field.dataType), values.affinity_of(field)
    side = "" if predicate.column.side < 0 else ("l_" if predicate.column.side == 0 else "r_")
    column = F.col(f"`{side}{field.name}`")
    if predicate.op in ("is_null", "is_not_null"):
        null = values.is_null(column, kind)
        return null if predicate.op == "is_null" else ~null
    assert predicate.literal is not None
    cls, value = predicate.literal
    if affinity == "TEXT":
        if cls == "real":
            raise UnsupportedView("a REAL literal against a TEXT column is not supported; use a quoted string")
        if cls == "int":
            cls, value = "text", str(value)
    elif affinity in ("INTEGER", "REAL", "NUMERIC") and cls == "text":
        text = str(value).strip(" \t\n\v\f\r")
        if re.fullmatch(r"[+-]?\d+", text) and -(2**63) <= int(text) < 2**63:
            cls, value = "int", int(text)
        elif re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
            cls, value = "real", float(text)
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}[predicate.op]
    if kind == "dyn":
        cell = {"int": lambda: values.int_cell(F.lit(value).cast("bigint")), "real": lambda: values.real_cell(F.lit(float(value))), "text": lambda: values.text_cell(F.lit(value)), "blob": lambda: values.blob_cell(F.unhex(F.lit(value)))}[cls]()
        return ~values.is_null(column, kind) & compare(values.exact_order(column, kind), values.exact_order(cell, kind))
    if kind == "time" and cls == "text":
        return compare(column, F.lit(value).cast(field.dataType))
    number = kind in ("int", "real", "decimal", "bool")
    if number and cls in ("int", "real"):
        return _numeric_condition(column, kind, predicate.op, cls, value, compare)
    if kind == "text" and cls == "text":
        return compare(column, F.lit(value))
    if kind == "blob" and cls == "blob":
        return compare(column, F.unhex(F.lit(value)))
    # classes differ: numbers (and times) come before text, text before blobs
    rank = {"int": 1, "real": 1, "text": 2, "blob": 3}
    own = 1 if number or kind == "time" else 2 if kind == "text" else 3
    if own == rank[cls] or kind == "other":
        raise UnsupportedView(f"column {field.name} cannot be compared with that literal")
    always = (predicate.op in ("<", "<=", "!=")) if own < rank[cls] else predicate.op in (">", ">=", "!=")
    return column.isNotNull() if always else F.lit(False)


def _numeric_condition(column: Column, kind: str, op: str, cls: str, value: object, compare) -> Column:
    """A number column against a number, by exact value: no integer is rounded to a double."""
    if kind == "bool":
        column = column.cast("bigint")
    if kind in ("int", "bool") and cls == "real":
        real = float(value)  # type: ignore[arg-type]
        if real != real:
            return F.lit(False)
        if abs(real) >= 2.0**63:
            above = real > 0
            return column.isNotNull() if (op in ("<", "<=", "!=")) == above or op == "!=" else F.lit(False)
        floor = int(real // 1)
        if real == floor:
            return compare(column, F.lit(floor).cast("bigint"))
        if op in ("=", "!="):
            return F.lit(False) if op == "=" else column.isNotNull()
        return column <= F.lit(floor).cast("bigint") if op in ("<", "<=") else column > F.lit(floor).cast("bigint")
    if kind == "real" and cls == "int" and abs(int(value)) > 2**53:  # type: ignore[call-overload]
        as_cell, literal = values.exact_order(values.real_cell(column), "dyn"), values.exact_order(values.int_cell(F.lit(value).cast("bigint")), "dyn")
        return column.isNotNull() & compare(as_cell, literal)
    if kind == "decimal" and cls == "int":
        return compare(column, F.lit(value).cast("decimal(20,0)"))
    return compare(column, F.lit(value))


class Engine:
    """Tables and views below *root*, a folder all executors share (by default one that ends with the process).

    *buckets* are those of each table and view made from now on; by default as many as the table or the state has bytes for.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.buckets = spark, buckets
        self.store = Store(spark, root or work_path(spark, "engine"))
        self.manifest = self.store.load()

    # tables

    def _table(self, name: str) -> tuple[str, dict]:
        for known, meta in self.manifest["tables"].items():
            if known.lower() == name.lower():
                return known, meta
        raise UnknownTable(f"no such table: {name}")

    def _declared(self, name: str) -> tuple[str, list[str]] | None:
        try:
            known, meta = self._table(name)
        except UnknownTable:
            if any(v.lower() == name.lower() for v in self.manifest["views"]):
                raise UnsupportedView(f"{name} is a view: views over views are not supported") from None
            return None
        return known, changelog.schema_of(meta).fieldNames()

    def create_table(self, name: str, rows: DataFrame | T.StructType, unique: Iterable[Iterable[str]] = ()) -> None:
        """Declare a base table with its first rows, or an empty one by schema; *unique* are the keys replace() goes by."""
        schema = rows if isinstance(rows, T.StructType) else T.StructType([f for f in rows.schema.fields if f.name != W])
        schema = values.nullable(schema)
        self._free_name(name, "table")
        for f in schema.fields:
            if f.name.lower().startswith(PREFIX) or f.name.lower() in (W, "rowid", "oid", "_rowid_"):
                raise UnsupportedView(f"column name {f.name} is reserved")
        if len({f.name.lower() for f in schema.fields}) < len(schema.fields):
            raise UnsupportedView(f"table {name} has two columns of one name")
        keys = [[next((f.name for f in schema.fields if f.name.lower() == c.lower()), None) for c in key] for key in unique]
        if any(c is None for key in keys for c in key):
            raise UnsupportedView(f"a unique key of {name} names a column it doesn't have")
        hashed = [f.name for f in schema.fields if values.kind_of(f.dataType) != "other"] or schema.fieldNames()
        meta = {"schema": schema.json(), "unique": keys, "by": keys[0] if keys else hashed, "buckets": self._buckets_for(input_bytes(rows) if isinstance(rows, DataFrame) else 0), "snapshot": None, "segments": [], "next": 1, "batches": {}}
        if isinstance(rows, DataFrame):
            meta["snapshot"] = self._snapshot(name, meta, changelog.conform(rows, schema))
        self._commit(lambda m: m["tables"].__setitem__(name, meta))

    def _buckets_for(self, size: int) -> int:
        return self.buckets or max(1, -(-size // BUCKET_BYTES))

    def _snapshot(self, name: str, meta: dict, rows: DataFrame) -> dict[str, str]:
        path = self.store.fresh(f"{name}-snapshot")
        return self._write_buckets(path, rows, changelog.bucket_of(meta), meta["buckets"], spread=True)

    def drop_table(self, name: str) -> None:
        """Remove a base table; views over it are broken from then on."""
        known, _ = self._table(name)
        self._commit(lambda m: m["tables"].pop(known))

    def redeclare_table(self, name: str, schema: T.StructType) -> None:
        """Change a table's columns: added ones are NULL in the rows there are, missing ones are dropped. Breaks views over it."""
        known, meta = self._table(name)
        schema = values.nullable(schema)
        old = changelog.as_of(self.spark, meta)
        rows = old.select(*[(F.col(f"`{f.name}`") if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields], W)
        unique = [k for k in meta["unique"] if all(c in schema.fieldNames() for c in k)]
        new = meta | {"schema": schema.json(), "segments": [], "unique": unique, "by": unique[0] if unique else schema.fieldNames()}
        new["snapshot"] = self._snapshot(known, new, zset.consolidate(rows))
        self._commit(lambda m: m["tables"].__setitem__(known, new))

    def base(self, name: str, position: int | None = None) -> DataFrame:
        """Rows of a base table now, each as often as it is there."""
        _, meta = self._table(name)
        rows = zset.consolidate(changelog.as_of(self.spark, meta, position))
        return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(W)))).drop("__copy", W)

    def apply(self, name: str, delta: DataFrame, check: bool = True, batch: tuple[str, int] | None = None) -> int:
        """Capture weighted changes (column _w; +1 where absent); gives their log position.

        A change that would remove a row that is not there is refused, unless *check* is off for a source that cannot send
        one. *batch* = (query, id) makes a repeated micro-batch a no-op.
        """
        known, meta = self._table(name)
        if batch and meta["batches"].get(batch[0], -1) >= batch[1]:
            return changelog.head(meta)
        position = meta["next"]
        path = self.store.fresh(f"{known}-log")
        changelog.conform(delta, changelog.schema_of(meta)).write.parquet(path)
        if check:
            written = changelog.read(self.spark, meta, [path])
            # no more bucket numbers than buckets
            touched = [r[0] for r in written.where(F.col(W) < 0).select(changelog.bucket_of(meta)).distinct().collect()]
            if touched and changelog.missing_rows(self.spark, meta, written, touched, stored_bytes(self.spark, path) <= SMALL_DELTA).limit(1).count():
                self.store.remove(path)
                raise IllegalChange(f"a change of {known} removes a row that is not there")

        def change(m: dict) -> None:
            m["tables"][known]["segments"].append([position, path])
            m["tables"][known]["next"] = position + 1
            if batch:
                m["tables"][known]["batches"][batch[0]] = batch[1]

        self._commit(change)
        return position

    def insert(self, name: str, rows: DataFrame) -> int:
        return self.apply(name, zset.weighted(rows), check=False)

    def delete(self, name: str, rows: DataFrame) -> int:
        """Remove each of *rows* once; all columns identify a row."""
        return self.apply(name, zset.weighted(rows, -1))

    def update(self, name: str, old: DataFrame, new: DataFrame) -> int:
        return self.apply(name, zset.weighted(old, -1).unionByName(zset.weighted(new)))

    def replace(self, name: str, rows: DataFrame) -> int:
        """Insert *rows* after removing whatever shares a unique key with them; two of *rows* may not share one."""
        known, meta = self._table(name)
        given = changelog.conform(rows, changelog.schema_of(meta))
        for key in meta["unique"]:
            there = changelog.unique_keys(meta, key, given)
            if there.groupBy(*there.columns).count().where(F.col("count") > 1).limit(1).count():
                raise IllegalChange(f"rows to replace share the unique key {key} among themselves")
        removed = changelog.replaced_rows(self.spark, meta, given)
        return self.apply(known, given.unionByName(removed), check=False)

    # views

    def _free_name(self, name: str, what: str) -> None:
        if name.lower().startswith(PREFIX):
            raise UnsupportedView(f"{what} name {name} starts with {PREFIX}")
        if any(name.lower() == x.lower() for x in [*self.manifest["tables"], *self.manifest["views"]]):
            raise UnsupportedView(f"there is already a table or view {name}")

    def _layout(self, spec: ViewSpec) -> tuple[Layout, list[T.StructType]]:
        schemas = [changelog.schema_of(self._table(t)[1]) for t in spec.tables]
        layout = Layout.of(spec, schemas)
        for a in spec.aggregates:
            if a.column is not None:
                field = schemas[a.column.side][a.column.name]
                kind = values.kind_of(field.dataType)
                if a.kind in ("sum", "total", "avg") and kind not in _SUMMABLE:
                    raise UnsupportedView(f"{a.kind.upper()} of column {field.name} ({field.dataType.simpleString()}) is not supported")
                if a.kind in ("min", "max") and kind == "other":
                    raise UnsupportedView(f"{a.kind.upper()} of column {field.name} ({field.dataType.simpleString()}) is not supported")
        for ref, _ in spec.keys:
            if values.kind_of(schemas[ref.side][ref.name].dataType) == "other":
                raise UnsupportedView(f"column {ref.name} cannot be a group key")
        if spec.join:
            left, right = (schemas[r.side][r.name] for r in spec.join)
            if values.affinity_of(left) != values.affinity_of(right) or values.kind_of(left.dataType) != values.kind_of(right.dataType):
                raise UnsupportedView(f"columns {left.name} and {right.name} of a join have different affinities")
        if spec.predicate:
            literal_condition(spec.predicate, schemas[spec.predicate.column.side][spec.predicate.column.name])
        return layout, schemas

    def _rows(self, spec: ViewSpec, layout: Layout, schemas: list[T.StructType], weighted_rows: DataFrame) -> DataFrame:
        """Filter and projection of joined or single rows (columns l_*, r_*) to the layout's keys and inputs."""
        condition = None
        if spec.predicate:
            condition = literal_condition(spec.predicate, schemas[spec.predicate.column.side][spec.predicate.column.name])
        at = lambda ref: F.col(f"`{'lr'[ref.side]}_{ref.name}`")
        columns = [at(k).alias(f"k{i}") for i, (k, _) in enumerate(spec.keys)] + [at(c).alias(f"v{j}") for j, c in enumerate(layout.columns)]
        return zset.projected(zset.filtered(weighted_rows, condition), columns)

    def _sided(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").alias(f"l_{c}") for c in df.columns if c != W], W)

    def _join_keys(self, spec: ViewSpec, schemas: list[T.StructType]) -> tuple[Column, Column]:
        left, right = (values.join_key(F.col(f"`{r.name}`"), values.kind_of(schemas[r.side][r.name].dataType)) for r in spec.join or ())
        return left, right

    def _needed(self, spec: ViewSpec, layout: Layout, side: int, rows: DataFrame) -> DataFrame:
        """Only the columns of one side that the view uses; coinciding rows add up later."""
        refs = [k for k, _ in spec.keys] + list(layout.columns) + list(spec.join or ()) + ([spec.predicate.column] if spec.predicate else [])
        names = dict.fromkeys(r.name for r in refs if r.side == side)
        return rows.select(*[F.col(f"`{n}`") for n in names], W)

    def _joined(self, spec: ViewSpec, schemas: list[T.StructType], left: DataFrame, right: DataFrame) -> DataFrame:
        return zset.joined(left, right, *self._join_keys(spec, schemas))

    def _bases(self, spec: ViewSpec, layout: Layout) -> list[DataFrame]:
        return [self._needed(spec, layout, i, changelog.as_of(self.spark, self._table(t)[1])) for i, t in enumerate(spec.tables)]

    def _write_buckets(self, path: str, df: DataFrame, bucket: Column, buckets: int, spread: bool = False) -> dict[str, str]:
        """Write by bucket; gives {bucket: path} of what was written. *spread* lets several tasks write a bucket where there are more tasks."""
        if buckets == 1:
            df.write.parquet(f"{path}/__b=0")
            return {"0": f"{path}/__b=0"} if any(c.endswith(".parquet") for c in self.store.children(f"{path}/__b=0")) else {}
        bucketed = df.withColumn("__b", bucket)
        per = max(1, slots(self.spark) // buckets) if spread else 1
        parts = [F.pmod(F.hash(*[F.col(f"`{c}`") for c in df.columns]), F.lit(per))] if per > 1 else []
        bucketed.repartition(F.col("__b"), *parts).write.partitionBy("__b").parquet(path)
        return {c[4:]: f"{path}/{c}" for c in self.store.children(path) if c.startswith("__b=")}

    def _append(self, view: dict, name: str, part: str, df: DataFrame, keys: list[Column], spread: bool = False) -> dict[str, str]:
        """Write one run of a part and enter it in *view*; gives {bucket: path}."""
        n = view["side_buckets" if part in ("left", "right") else "buckets"]
        made = self._write_buckets(self.store.fresh(f"{name}-{part}"), df, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"), n, spread)
        view["schemas"][part] = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]).json()
        held = view["parts"].setdefault(part, {})
        for b, p in made.items():
            held[b] = [*held.get(b, []), p]
        return made

    def _read(self, view: dict, part: str, paths: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(view["schemas"][part]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _runs(self, view: dict, part: str, buckets: Iterable[str] | None = None) -> DataFrame:
        """All runs of a part, or of some of its buckets; their rows add up."""
        held = view["parts"].get(part, {})
        return self._read(view, part, [p for b in (held if buckets is None else buckets) for p in held.get(b, [])])

    def _few(self, df: DataFrame, made: dict[str, str]) -> DataFrame:
        """*df*, read from one run, with a broadcast hint if its files are small."""
        held = stored_bytes(self.spark, next(iter(made.values())).rsplit("/", 1)[0])
        return F.broadcast(df) if held <= SMALL_DELTA else df

    def _keys_of(self, part: str, spec: ViewSpec, layout: Layout, schemas: list[T.StructType]) -> list[Column]:
        """What a part is bucketed by."""
        if part == "out":
            return [values.canonical(F.col(f"`{n}`"), kind) for (_, n), kind in zip(spec.keys, layout.key_kinds)]
        if part == "state":
            return [F.col(k) for k in layout.keys]
        return [self._join_keys(spec, schemas)[part == "right"]]

    def _watched(self, df: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, Callable[[], None]]:
        """*df*, and a check of what was seen while it was computed: rows that meet a condition raise its message.

        Spark drops the watch where what is made of *df* turns out empty; then the rows are counted by a job of their own.
        """
        if not conditions:
            return df, lambda: None
        seen = Observation()
        counted = [F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(f"f{i}") for i, c in enumerate(conditions.values())]
        watched = df.observe(seen, *counted)

        def check() -> None:
            try:
                counts = seen.get
            except Py4JJavaError:
                counts = {}
            if len(counts) < len(conditions):
                counts = df.agg(*counted).first().asDict()
            for i, message in enumerate(conditions):
                if counts[f"f{i}"]:
                    raise (SumOverflow if "overflow" in message else StateError)(message)

        return watched, check

    def _advance(self, name: str, view: dict, spec: ViewSpec, layout: Layout, schemas: list[T.StructType], bootstrap: bool) -> dict:
        """The view's entry after all changes up to now; nothing is visible before it is committed."""
        new = copy.deepcopy(view)
        new["applied"] = {t: changelog.head(self._table(t)[1]) for t in spec.tables}
        by = lambda part: self._keys_of(part, spec, layout, schemas)
        rows = self._join_change(name, view, new, spec, layout, schemas, bootstrap) if spec.join else self._change(view, spec, layout, schemas, bootstrap)
        new["changed"] = []
        if rows is None:
            return new
        delta = living(layout, partial(layout, rows))
        delta, checked = self._watched(delta, entry_faults(layout) if bootstrap else {})
        if bootstrap and not self.buckets:
            made = self._sized(name, new, delta, by("state"))
        else:
            made = self._append(new, name, "state", delta, by("state"), spread=bootstrap)
        checked()
        if not made and not bootstrap:
            return new
        came = self._read(new, "state", list(made.values()))
        if bootstrap:
            groups, output = finalize(layout, came)
            groups, agreed = self._watched(groups, group_faults(layout))
            change = zset.weighted(with_package(output(groups)))
        else:
            touched = self._few(came.select(*[F.col(k).alias(f"t{i}") for i, k in enumerate(layout.keys)]).distinct(), made)
            held = self._runs(view, "state", made).join(touched, [F.col(k).eqNullSafe(F.col(f"t{i}")) for i, k in enumerate(layout.keys)], "left_semi")
            sides = held.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).unionByName(came.withColumn("side", F.lit(1)))
            is_new = F.col("side") == 1
            merged, checked = self._watched(merge(layout, sides, ("side",)), {m: is_new & c for m, c in entry_faults(layout).items()})
            groups, output = finalize(layout, merged, ("side",))
            groups, agreed = self._watched(groups, {m: is_new & c for m, c in group_faults(layout).items()})
            both = with_package(output(groups))
            change = zset.consolidate(both.withColumn(W, F.when(is_new, 1).otherwise(-1).cast("bigint")).drop("side"))
        new["changed"] = list(self._append(new, name, "out", change, by("out"), spread=bootstrap).values())
        checked()
        agreed()
        if self._outgrown(new):
            many = self._buckets_for(self._state_bytes(new))
            new["buckets"], old = many, copy.deepcopy(new)
            for part in ("state", "out"):
                new["parts"][part] = {}
                self._append(new, name, part, self._added(part, layout, self._runs(old, part)), by(part), spread=True)
        for part in new["parts"]:
            self._merge_runs(name, new, part, layout, by(part))
        return new

    def _state_bytes(self, view: dict) -> int:
        return sum(stored_bytes(self.spark, p) for runs in view["parts"]["state"].values() for p in runs)

    def _outgrown(self, view: dict) -> bool:
        """Whether the state is due for more buckets; looked at only where runs are due to be merged."""
        due = any(len(runs) > MAX_RUNS for runs in view["parts"]["state"].values())
        return bool(due and not self.buckets and self._state_bytes(view) > 4 * view["buckets"] * BUCKET_BYTES)

    def _added(self, part: str, layout: Layout, runs: DataFrame) -> DataFrame:
        return merge(layout, runs) if part == "state" else zset.consolidate(runs)

    def _sized(self, name: str, view: dict, state: DataFrame, keys: list[Column]) -> dict[str, str]:
        """Write a first state as one bucket, and again as several if it turns out to be large."""
        view["buckets"] = 1
        made = self._append(view, name, "state", state, keys, spread=True)
        view["buckets"] = self._buckets_for(stored_bytes(self.spark, made["0"])) if made else 1
        if view["buckets"] > 1:
            view["parts"]["state"] = {}
            whole = self._read(view, "state", [made["0"]])
            written = made["0"].rsplit("/", 1)[0]
            made = self._append(view, name, "state", whole, keys, spread=True)
            self.store.remove(written)
        return made

    def _change(self, view: dict, spec: ViewSpec, layout: Layout, schemas: list[T.StructType], bootstrap: bool) -> DataFrame | None:
        """Weighted rows of a view over one table that are new to it."""
        if bootstrap:
            rows = self._bases(spec, layout)[0]
        else:
            found = changelog.changes(self.spark, self._table(spec.tables[0])[1], view["applied"][spec.tables[0]])
            if found is None:
                return None
            rows = self._needed(spec, layout, 0, found)
        return self._rows(spec, layout, schemas, self._sided(rows))

    def _join_change(self, name: str, view: dict, new: dict, spec: ViewSpec, layout: Layout, schemas: list[T.StructType], bootstrap: bool) -> DataFrame | None:
        """Weighted rows of a join that are new to it; the changes of both sides are entered in *new*'s arrangements.

        The change of the left side meets the right side as it was, the change of the right side the left side as it is now;
        each only in the buckets that the change touches. Rows without join key match nothing and are not kept.
        """
        keys = self._join_keys(spec, schemas)

        def enter(i: int) -> dict[str, str]:
            part, t = ("left", "right")[i], spec.tables[i]
            found = self._bases(spec, layout)[i] if bootstrap else changelog.changes(self.spark, self._table(t)[1], view["applied"][t])
            if found is None:
                return {}
            rows = zset.consolidate(self._needed(spec, layout, i, found)).where(keys[i].isNotNull())
            return self._append(new, name, part, rows, [keys[i]], spread=bootstrap)

        with ThreadPoolExecutor(2) as pool:
            left, right = pool.map(enter, (0, 1))
        parts = []
        if bootstrap:
            parts.append(self._joined(spec, schemas, self._runs(new, "left"), self._runs(new, "right")))
        else:
            if left:
                parts.append(self._joined(spec, schemas, self._few(self._read(new, "left", list(left.values())), left), self._runs(view, "right", left)))
            if right:
                parts.append(self._joined(spec, schemas, self._runs(new, "left", right), self._few(self._read(new, "right", list(right.values())), right)))
        return self._rows(spec, layout, schemas, zset.union(*parts)) if parts else None

    def _merge_runs(self, name: str, view: dict, part: str, layout: Layout, keys: list[Column]) -> None:
        """Merge the runs of buckets that have many."""
        many = [b for b, runs in view["parts"][part].items() if len(runs) > MAX_RUNS]
        if many:
            runs = self._runs(view, part, many)
            for b in many:
                del view["parts"][part][b]
            self._append(view, name, part, self._added(part, layout, runs), keys, spread=True)

    def create_view(self, name: str, sql: str) -> None:
        """Define a view and compute it once from its tables; a failure leaves nothing behind."""
        self._free_name(name, "view")
        spec = parse_view(sql, self._declared)
        if any(n.lower() == name.lower() for n in spec.outputs):
            raise UnsupportedView(f"an output column is named like the view: {name}")
        layout, schemas = self._layout(spec)
        view = {"sql": sql, "plan": spec.fingerprint(), "format": FORMAT, "buckets": self._buckets_for(0), "side_buckets": self._buckets_for(max(map(input_bytes, self._bases(spec, layout)))), "tables": {t: changelog.fingerprint(s) for t, s in zip(spec.tables, schemas)}, "applied": {}, "parts": {}, "schemas": {}, "changed": []}
        made = self._advance(name, view, spec, layout, schemas, bootstrap=True)
        self._commit(lambda m: m["views"].__setitem__(name, made))

    def _view(self, name: str) -> tuple[str, dict]:
        for known, view in self.manifest["views"].items():
            if known.lower() == name.lower():
                return known, view
        raise UnknownTable(f"no such view: {name}")

    def broken(self, name: str) -> str | None:
        """Why a view can only be dropped, or None."""
        _, view = self._view(name)
        if view.get("format") != FORMAT:
            return f"the view was stored in format {view.get('format')}, this is format {FORMAT}: drop and create it again"
        try:
            spec = parse_view(view["sql"], self._declared)
            _, schemas = self._layout(spec)
        except ViewError as e:
            return str(e)
        if spec.fingerprint() != view["plan"]:
            return "the stored query now means a different plan"
        for t, s in zip(spec.tables, schemas):
            if view["tables"].get(t) != changelog.fingerprint(s):
                return f"the columns of table {t} have changed"
        for part, held in view["parts"].items():
            for path in {p for runs in held.values() for p in runs}:
                if not self.store.exists(path):
                    return f"stored {part} is missing: {path}"
        return None

    def _sound(self, name: str) -> tuple[str, dict, ViewSpec, Layout, list[T.StructType]]:
        known, view = self._view(name)
        why = self.broken(known)
        if why:
            raise BrokenView(f"view {known} is broken: {why}")
        spec = parse_view(view["sql"], self._declared)
        return known, view, spec, *self._layout(spec)

    def _stale(self, view: dict) -> bool:
        return any(changelog.head(self._table(t)[1]) > n for t, n in view["applied"].items())

    def refresh(self, name: str) -> bool:
        """Bring a view up to date; False if there was nothing new (no Spark job is run then)."""
        known, view, *rest = self._sound(name)
        if not self._stale(view):
            return False
        new = self._advance(known, view, *rest, bootstrap=False)
        self._commit(lambda m: m["views"].__setitem__(known, new))
        return True

    def refresh_all(self, mode: str = "atomic") -> int | str:
        """Refresh every view. 'atomic': all or none, gives how many were refreshed. 'continue': each on its own, gives a report."""
        if mode not in ("atomic", "continue"):
            raise ViewError(f"refresh_all: unknown mode {mode!r}, use 'atomic' or 'continue'")
        names = sorted(self.manifest["views"])

        def stage(name: str) -> dict | None | Exception:
            """The view's next entry, None if nothing is new, or why it fails."""
            try:
                known, view, *rest = self._sound(name)
                return self._advance(known, view, *rest, bootstrap=False) if self._stale(view) else None
            except Exception as e:
                return e

        with ThreadPoolExecutor(VIEWS_AT_ONCE) as pool:
            found = dict(zip(names, pool.map(stage, names)))
        failed = {n: x for n, x in found.items() if isinstance(x, Exception)}
        staged = {n: x for n, x in found.items() if isinstance(x, dict)}
        if failed and mode == "atomic":
            name, why = next(iter(failed.items()))
            raise ViewError(f"refresh_all: view {name}: {why}; no view was refreshed") from why
        if staged:
            self._commit(lambda m: m["views"].update(staged))
        if mode == "atomic":
            return len(staged)
        report = f"refreshed {len(staged)}, skipped {len(names) - len(staged) - len(failed)}, failed {len(failed)}"
        return report + (": " + "; ".join(f"{n}: {x}" for n, x in failed.items()) if failed else "")

    def table(self, name: str) -> DataFrame:
        """The view's rows as of its last refresh. Only buckets with several runs are added up."""
        _, view, *_ = self._sound(name)
        return self._output(view)

    def _output(self, view: dict) -> DataFrame:
        held = view["parts"].get("out", {})
        settled = [b for b, runs in held.items() if len(runs) == 1]
        rows = self._runs(view, "out", settled).drop(W)
        if len(settled) < len(held):
            rows = rows.unionByName(zset.consolidate(self._runs(view, "out", [b for b in held if b not in set(settled)])).drop(W))
        return rows

    def last_changes(self, name: str) -> DataFrame:
        """What the last refresh changed in the output: rows taken out (_w -1) and put in (_w 1)."""
        _, view, *_ = self._sound(name)
        return self._read(view, "out", view["changed"])

    def drop_view(self, name: str) -> None:
        """Remove a view, broken or not, with its state."""
        known, view = self._view(name)
        self._commit(lambda m: m["views"].pop(known))
        for folder in self._folders(view):
            self.store.remove(folder)

    @staticmethod
    def _folders(view: dict) -> set[str]:
        runs = [p for held in view["parts"].values() for runs in held.values() for p in runs]
        return {p.rsplit("/", 1)[0] for p in [*runs, *view["changed"]]}

    def rename_view(self, name: str, new: str) -> None:
        raise ViewError(f"view {name} cannot be renamed; drop it and create {new}")

    def recompute(self, name: str) -> DataFrame:
        """The view's query evaluated from the base tables as they are now, without its state."""
        known, view, spec, layout, schemas = self._sound(name)
        bases = self._bases(spec, layout)
        rows = self._joined(spec, schemas, *bases) if spec.join else self._sided(bases[0])
        groups, output = finalize(layout, living(layout, partial(layout, self._rows(spec, layout, schemas, rows))))
        return with_package(output(groups))

    # housekeeping

    def compact(self, name: str) -> int:
        """Fold log segments that every view over the table has applied into its snapshot; gives how many were folded."""
        known, meta = self._table(name)
        readers = [v["applied"][known] for v in self.manifest["views"].values() if known in v["applied"]]
        upto = min([changelog.head(meta), *readers])
        folded = [s for s in meta["segments"] if s[0] <= upto]
        if not folded:
            return 0
        snapshot = self._snapshot(known, meta, zset.consolidate(changelog.as_of(self.spark, meta, upto)))

        def change(m: dict) -> None:
            m["tables"][known]["snapshot"] = snapshot
            m["tables"][known]["segments"] = [s for s in meta["segments"] if s[0] > upto]

        self._commit(change)
        return len(folded)

    def vacuum(self) -> int:
        """Delete data no manifest entry refers to; not while another process reads older results."""
        used = {p for t in self.manifest["tables"].values() for p in [*[x.rsplit("/", 1)[0] for x in (t["snapshot"] or {}).values()], *[p for _, p in t["segments"]]]}
        for v in self.manifest["views"].values():
            used |= self._folders(v)
        gone = [n for n in self.store.children(f"{self.store.root}/data") if f"{self.store.root}/data/{n}" not in used]
        for n in gone:
            self.store.remove(f"{self.store.root}/data/{n}")
        return len(gone)

    def _commit(self, change) -> None:
        new = copy.deepcopy(self.manifest)
        change(new)
        self.store.commit(new)
        self.manifest = new

    # statements

    def sql(self, statement: str) -> DataFrame | int | str | bool | None:
        """CREATE VIRTUAL TABLE v USING ivm('...') or CREATE MATERIALIZED VIEW v AS ..., INSERT INTO v(v) VALUES('refresh') or
        REFRESH MATERIALIZED VIEW v, DROP TABLE v or DROP MATERIALIZED VIEW v, SELECT refresh_all(['mode']), or any query over
        tables and views, which Spark answers."""
        text = statement.strip().rstrip(";").strip()
        name = r"([^\W\d]\w*)"
        match = lambda pattern: re.fullmatch(pattern, text, re.I | re.S)
        if m := match(rf"CREATE\s+VIRTUAL\s+TABLE\s+{name}\s+USING\s+\w+\s*\(\s*'((?:[^']|'')*)'\s*\)"):
            return self.create_view(m[1], m[2].replace("''", "'"))
        if m := match(rf"CREATE\s+MATERIALIZED\s+VIEW\s+{name}\s+AS\s+(.*)"):
            return self.create_view(m[1], m[2])
        if m := match(rf"INSERT\s+INTO\s+{name}\s*\(\s*{name}\s*(,[^)]*)?\)\s*VALUES\s*\(\s*'([^']*)'\s*(,.*)?\)"):
            known, _ = self._view(m[1])
            if m[2].lower() != known.lower():
                raise ViewError(f"view {known} is read-only")
            if m[3] or m[5]:
                raise ViewError("a command takes no other column value")
            if m[4].lower() != "refresh":
                raise ViewError(f"unknown command {m[4]!r}; the only one is 'refresh'")
            return self.refresh(known)
        if m := match(rf"REFRESH\s+MATERIALIZED\s+VIEW\s+{name}"):
            return self.refresh(m[1])
        if m := match(rf"DROP\s+(?:TABLE|MATERIALIZED\s+VIEW)\s+{name}"):
            return self.drop_view(m[1])
        if m := match(rf"ALTER\s+TABLE\s+{name}\s+RENAME\s+TO\s+{name}"):
            return self.rename_view(m[1], m[2])
        if m := match(r"SELECT\s+(?:ivm_)?refresh_all\s*\(\s*(?:'(\w+)')?\s*\)"):
            return self.refresh_all(m[1] or "atomic")
        if m := match(rf"(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+{name}.*"):
            if any(m[1].lower() == v.lower() for v in self.manifest["views"]):
                raise ViewError(f"view {m[1]} is read-only")
            raise ViewError("change base tables with insert, delete, update, replace or apply")
        if re.search(r"refresh_all\s*\(", text, re.I):
            raise ViewError("refresh_all must be called from a SELECT of its own")
        named = re.findall(r"\w+", text.lower())
        for t in self.manifest["tables"]:
            if t.lower() in named:
                self.base(t).createOrReplaceTempView(t)
        for v in self.manifest["views"]:
            if v.lower() in named:
                self.table(v).createOrReplaceTempView(v)
        return self.spark.sql(text)
