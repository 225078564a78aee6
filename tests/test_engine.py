import random
import sqlite3
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from driftwell.engine import Engine
from driftwell.functions import values
from driftwell.operators import zset
from driftwell.operators.zset import W
from driftwell.sources import changelog
from driftwell.plans.errors import BrokenView, IllegalChange, StateError, SumOverflow, UnsupportedView, ViewError

T = "k string, v long, r double"
ALL = "SELECT k, COUNT(*) AS n, COUNT(v) AS c, SUM(v) AS s, TOTAL(v) AS t, AVG(v) AS a, MIN(v) AS lo, MAX(v) AS hi, SUM(r) AS sr, AVG(r) AS ar, MIN(r) AS lr, MAX(r) AS hr FROM t{} GROUP BY k"


def rows_of(df):
    return Counter(map(repr, map(tuple, df.collect())))


def brute(rows, where=lambda v: True):
    out = Counter()
    for k in {r[0] for r in rows if where(r[1])}:
        mine = [r for r in rows if r[0] == k and where(r[1])]
        vs, rs = [r[1] for r in mine if r[1] is not None], [r[2] for r in mine if r[2] is not None]
        exact = lambda xs, n: float(sum(map(Fraction, xs)) / n)
        out[repr((k, len(mine), len(vs), sum(vs) if vs else None, float(sum(vs)), exact(vs, len(vs)) if vs else None, min(vs, default=None), max(vs, default=None), exact(rs, 1) if rs else None, exact(rs, len(rs)) if rs else None, min(rs, default=None), max(rs, default=None)))] += 1
    return out


def make(rng):
    pick = lambda xs: None if rng.random() < 0.2 else rng.choice(xs)
    return (pick(["a", "b", "c", "d"]), pick([0, 1, 2, 5, -7, 2**57, -(2**57)]), pick([0.1, 0.2, 0.3, 1e16, -1e16, 2.5]))


@pytest.mark.parametrize("seed,where,predicate", [(1, "", lambda v: True), (2, " WHERE v >= 1", lambda v: v is not None and v >= 1)])
def test_equals_recompute_after_every_batch(spark, seed, where, predicate):
    rng = random.Random(seed)
    live = [make(rng) for _ in range(25)]
    engine = Engine(spark, buckets=3)
    engine.create_table("t", spark.createDataFrame(live, T))
    engine.create_view("w", ALL.format(where))
    assert rows_of(engine.table("w")) == brute(live, predicate)
    for _ in range(2):
        gone = [live.pop(rng.randrange(len(live))) for _ in range(rng.randrange(8))]
        came = [make(rng) for _ in range(rng.randrange(8))]
        live += came
        engine.apply("t", spark.createDataFrame([(*r, -1) for r in gone] + [(*r, 1) for r in came], T + f", {W} long"))
        engine.refresh("w")
        assert rows_of(engine.table("w")) == brute(live, predicate)
    assert rows_of(engine.recompute("w")) == brute(live, predicate)
    engine.delete("t", spark.createDataFrame(live, T))
    engine.refresh("w")
    assert engine.table("w").count() == 0


def test_join_with_both_sides_changing(spark):
    engine = Engine(spark, buckets=2)
    engine.create_table("l", spark.createDataFrame([(1, 1), (2, 1), (3, None)], "id long, j long"))
    engine.create_table("r", spark.createDataFrame([(1, "x"), (None, "null"), (5, "y")], "j long, g string"))
    engine.create_view("w", "SELECT g, COUNT(*) AS n, SUM(id) AS s FROM l JOIN r ON l.j = r.j GROUP BY g")
    assert rows_of(engine.table("w")) == Counter([repr(("x", 2, 3))])
    engine.apply("l", spark.createDataFrame([(4, 5, 1), (1, 1, -1)], f"id long, j long, {W} long"))
    engine.apply("r", spark.createDataFrame([(1, "z", 1), (5, "y", -1), (5, "yy", 1)], f"j long, g string, {W} long"))
    engine.refresh("w")
    assert rows_of(engine.table("w")) == Counter(map(repr, [("x", 1, 2), ("z", 1, 2), ("yy", 1, 4)]))


def test_a_delta_join_with_the_old_left_side_would_be_wrong(spark):
    """Planted bug: R_old in place of R_new loses the pairs of two new rows."""
    key = F.col("j")
    old_r, dr = spark.createDataFrame([(1, 1)], f"j long, {W} long"), spark.createDataFrame([(2, 1)], f"j long, {W} long")
    old_s, ds = spark.createDataFrame([(1, 1)], f"j long, {W} long"), spark.createDataFrame([(2, 1)], f"j long, {W} long")
    right = zset.delta_join(dr, old_s, zset.union(old_r, dr), ds, key, key)
    wrong = zset.delta_join(dr, old_s, old_r, ds, key, key)
    assert right.agg(F.sum(W)).first()[0] == 1 and wrong.count() == 0


def test_extremes_retract_and_updates_move_groups(spark):
    engine = Engine(spark, buckets=2)
    base = spark.createDataFrame([("a", 1, None), ("a", 9, None), ("a", 9, None), ("b", 4, None)], T)
    engine.create_table("t", base)
    engine.create_view("w", "SELECT k, MIN(v) AS lo, MAX(v) AS hi FROM t GROUP BY k")
    engine.delete("t", spark.createDataFrame([("a", 9, None)], T))
    engine.refresh("w")
    assert ("a", 1, 9) in [tuple(r) for r in engine.table("w").collect()]  # one copy of the maximum is left
    engine.delete("t", spark.createDataFrame([("a", 9, None)], T))
    engine.update("t", spark.createDataFrame([("b", 4, None)], T), spark.createDataFrame([("c", 4, None)], T))
    engine.refresh("w")
    assert sorted(map(tuple, engine.table("w").collect())) == [("a", 1, 1), ("c", 4, 4)]
    assert {(r.k, r[W]) for r in engine.last_changes("w").collect()} == {("a", -1), ("a", 1), ("b", -1), ("c", 1)}


def test_sum_overflows_only_in_the_end_and_rolls_back(spark):
    engine = Engine(spark, buckets=2)
    top = 2**63 - 1
    engine.create_table("t", spark.createDataFrame([("a", top, None), ("a", top, None), ("a", -top, None), ("b", 1, None)], T))
    engine.create_view("w", "SELECT k, SUM(v) AS s FROM t GROUP BY k")
    engine.create_view("counts", "SELECT k, COUNT(*) AS n FROM t GROUP BY k")
    assert ("a", top) in [tuple(r) for r in engine.table("w").collect()]
    engine.insert("t", spark.createDataFrame([("a", 1, None), ("b", 1, None)], T))
    with pytest.raises(SumOverflow, match="integer overflow in SUM"):
        engine.refresh("w")
    assert ("b", 1) in [tuple(r) for r in engine.table("w").collect()]
    with pytest.raises(ViewError, match=r"refresh_all: view w: integer overflow.*no view was refreshed"):
        engine.refresh_all()
    assert ("b", 1) in [tuple(r) for r in engine.table("counts").collect()]
    assert engine.refresh_all("continue").startswith("refreshed 1, skipped 0, failed 1: w: integer overflow")
    assert ("b", 2) in [tuple(r) for r in engine.table("counts").collect()]
    engine.delete("t", spark.createDataFrame([("a", 1, None)], T))
    assert engine.refresh_all() == 2 and ("b", 2) in [tuple(r) for r in engine.table("w").collect()]
    assert engine.refresh_all("continue") == "refreshed 0, skipped 2, failed 0"
    with pytest.raises(ViewError, match="unknown mode"):
        engine.refresh_all("all")


def test_infinities_and_nan(spark):
    engine = Engine(spark, buckets=2)
    inf = float("inf")
    engine.create_table("t", spark.createDataFrame([("p", 1, inf), ("p", 1, 1.0), ("b", 1, inf), ("b", 1, -inf), ("n", 1, float("nan"))], T))
    engine.create_view("w", "SELECT k, SUM(r) AS s, TOTAL(r) AS t, COUNT(r) AS c FROM t GROUP BY k")
    got = {r.k: (r.s, r.t, r.c) for r in engine.table("w").collect()}
    assert got == {"p": (inf, inf, 2), "b": (None, None, 2), "n": (None, 0.0, 0)}
    engine.delete("t", spark.createDataFrame([("b", 1, -inf)], T))
    engine.refresh("w")
    assert {r.k: r.s for r in engine.table("w").collect()}["b"] == inf


def test_illegal_changes_are_refused(spark):
    engine = Engine(spark, buckets=2)
    engine.create_table("t", spark.createDataFrame([("a", 1, 0.5)], T))
    with pytest.raises(IllegalChange, match="not there"):
        engine.delete("t", spark.createDataFrame([("a", 1, 0.25)], T))
    with pytest.raises(IllegalChange, match="not there"):
        engine.delete("t", spark.createDataFrame([("a", 1, 0.5)] * 2, T))
    with pytest.raises(IllegalChange, match="don't fit"):
        engine.insert("t", spark.createDataFrame([("a",)], "k string"))
    assert engine.base("t").count() == 1
    engine.create_view("w", "SELECT k, COUNT(*) AS n FROM t GROUP BY k")
    engine.apply("t", spark.createDataFrame([("b", 1, 0.5, -1)], T + f", {W} long"), check=False)  # an unchecked source that lies
    with pytest.raises(StateError, match="not there"):
        engine.refresh("w")
    assert engine.table("w").count() == 1


def test_replace_by_every_unique_key(spark):
    engine = Engine(spark, buckets=2)
    schema = "id long, email string, g string"
    engine.create_table("t", spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "y"), (4, None, "y")], schema), unique=[["id"], ["email"]])
    engine.create_view("w", "SELECT g, COUNT(*) AS n FROM t GROUP BY g")
    engine.replace("t", spark.createDataFrame([(1, "b", "z"), (5, None, "z")], schema))  # (1, b) removes rows 1 and 2; NULL removes none
    engine.refresh("w")
    assert sorted(map(tuple, engine.table("w").collect())) == [("y", 2), ("z", 2)]
    with pytest.raises(IllegalChange, match="among themselves"):
        engine.replace("t", spark.createDataFrame([(9, "q", "z"), (9, "r", "z")], schema))


def test_lifecycle(spark):
    engine = Engine(spark, buckets=2)
    engine.create_table("t", spark.createDataFrame([("a", 1, 0.5)], T))
    engine.create_view("w", "SELECT k, COUNT(*) AS n FROM t GROUP BY k")
    for name, sql, message in [("w", "SELECT k, COUNT(*) AS n FROM t GROUP BY k", "already"), ("t", "SELECT k, COUNT(*) AS n FROM t GROUP BY k", "already"), ("__dw_x", "SELECT k, COUNT(*) AS n FROM t GROUP BY k", "starts with"), ("q", "SELECT k, COUNT(*) AS Q FROM t GROUP BY k", "like the view"), ("q", "SELECT k, COUNT(*) AS n FROM w GROUP BY k", "is a view"), ("q", "SELECT k, COUNT(*) AS n FROM t WHERE k > 1.5 GROUP BY k", "REAL literal")]:
        with pytest.raises(UnsupportedView, match=message):
            engine.create_view(name, sql)
    assert list(engine.manifest["views"]) == ["w"]
    with pytest.raises(UnsupportedView, match="reserved"):
        engine.create_table("bad", spark.createDataFrame([(1,)], "rowid long"))
    with pytest.raises(ViewError, match="cannot be renamed"):
        engine.rename_view("w", "x")
    engine.insert("t", spark.createDataFrame([("b", 1, 0.5)], T))
    again = Engine(spark, engine.store.root)
    assert again.refresh("W") and again.table("w").count() == 2
    with pytest.raises(StateError, match="another writer"):
        engine.insert("t", spark.createDataFrame([("c", 1, 0.5)], T))
    assert again.compact("t") == 1 and again.vacuum() > 0
    again.insert("t", spark.createDataFrame([("c", 1, 0.5)], T))
    assert again.refresh("w") and again.table("w").count() == 3 and again.base("t").count() == 3
    again.drop_view("w")
    assert again.manifest["views"] == {} and again.compact("t") == 1


def test_broken_views_say_why_and_can_be_dropped(spark):
    engine = Engine(spark, buckets=2)
    engine.create_table("t", spark.createDataFrame([("a", 1, 0.5)], T))
    for i in range(4):
        engine.create_view(f"w{i}", "SELECT k, COUNT(*) AS n FROM t GROUP BY k")
    engine._commit(lambda m: m["views"]["w0"].__setitem__("plan", "tampered"))
    engine._commit(lambda m: m["views"]["w1"].__setitem__("format", 0))
    for runs in engine.manifest["views"]["w2"]["parts"]["state"].values():
        engine.store.remove(runs[0])
    assert "different plan" in engine.broken("w0") and "format" in engine.broken("w1") and "is missing" in engine.broken("w2")
    schema = spark.createDataFrame([], T + ", extra string").schema
    engine.redeclare_table("t", schema)
    assert "have changed" in engine.broken("w3")
    for i in range(4):
        with pytest.raises(BrokenView, match=f"view w{i} is broken"):
            engine.refresh(f"w{i}")
        with pytest.raises(BrokenView):
            engine.table(f"w{i}")
    engine.drop_table("t")
    assert engine.broken("w3") == "no such table: t"
    for i in range(4):
        engine.drop_view(f"w{i}")
    assert engine.manifest["views"] == {}


def test_a_crash_before_the_commit_changes_nothing(spark, monkeypatch):
    engine = Engine(spark, buckets=2)
    engine.create_table("t", spark.createDataFrame([("a", 1, 0.5)], T))
    engine.create_view("w", "SELECT k, COUNT(*) AS n FROM t GROUP BY k")
    engine.insert("t", spark.createDataFrame([("a", 1, 0.5)], T))

    def crash(manifest):
        raise OSError("injected")

    monkeypatch.setattr(engine.store, "commit", crash)
    with pytest.raises(OSError):
        engine.refresh("w")
    assert engine.table("w").first().n == 1
    monkeypatch.undo()
    assert engine.refresh("w") and engine.table("w").first().n == 2


def test_a_refresh_appends_to_touched_buckets_and_many_runs_are_merged(spark, monkeypatch):
    engine = Engine(spark, buckets=8)
    engine.create_table("t", spark.createDataFrame([(f"k{i}", i, None) for i in range(64)], T))
    engine.create_view("w", "SELECT k, COUNT(*) AS n, MAX(v) AS hi FROM t GROUP BY k")
    before = engine.manifest["views"]["w"]["parts"]
    engine.insert("t", spark.createDataFrame([("k1", 99, None)], T))
    engine.refresh("w")
    after = engine.manifest["views"]["w"]["parts"]
    for part in before:
        grown = [b for b in before[part] if before[part][b] != after[part][b]]
        assert len(grown) == 1 and after[part][grown[0]][:-1] == before[part][grown[0]]
    assert {tuple(r) for r in engine.last_changes("w").collect()} == {("k1", 1, 1, -1), ("k1", 2, 99, 1)}
    monkeypatch.setattr("driftwell.engine.MAX_RUNS", 2)
    for v in (100, 7):
        engine.insert("t", spark.createDataFrame([("k1", v, None)], T))
        engine.refresh("w")
    assert all(len(runs) <= 2 for part in engine.manifest["views"]["w"]["parts"].values() for runs in part.values())
    engine.delete("t", spark.createDataFrame([("k1", 100, None), ("k1", 1, None)], T))
    engine.refresh("w")
    assert {tuple(r) for r in engine.table("w").where("k = 'k1'").collect()} == {("k1", 2, 99)} and engine.table("w").count() == 64


def files_read(df):
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def test_a_join_refresh_reads_only_matching_buckets_of_the_other_side(spark, monkeypatch):
    engine = Engine(spark, buckets=16)
    engine.create_table("l", spark.createDataFrame([(i, i % 40) for i in range(200)], "id long, j long"))
    engine.create_table("r", spark.createDataFrame([(i, f"g{i % 3}") for i in range(40)] + [(None, "null")], "j long, g string"))
    engine.create_view("w", "SELECT g, COUNT(*) AS n, SUM(id) AS s FROM l JOIN r ON l.j = r.j GROUP BY g")
    read = []
    plain = Engine._runs
    monkeypatch.setattr(Engine, "_runs", lambda self, view, part, buckets=None: read.append((part, None if buckets is None else len(list(buckets)))) or plain(self, view, part, buckets))
    engine.insert("l", spark.createDataFrame([(1000, 5), (1001, None)], "id long, j long"))
    engine.refresh("w")
    assert ("right", 1) in read and not any(part == "left" for part, _ in read)
    read.clear()
    engine.delete("r", spark.createDataFrame([(7, "g1")], "j long, g string"))
    engine.refresh("w")
    assert ("left", 1) in read and not any(part == "right" for part, _ in read)
    left = [(i, i % 40) for i in range(200)] + [(1000, 5)]
    right = {i: f"g{i % 3}" for i in range(40) if i != 7}
    wanted = Counter()
    for g in ("g0", "g1", "g2"):
        mine = [i for i, j in left if right.get(j) == g]
        wanted[repr((g, len(mine), sum(mine)))] = 1
    assert rows_of(engine.table("w")) == wanted


def test_removed_rows_are_looked_for_in_their_buckets(spark):
    engine = Engine(spark, buckets=16)
    engine.create_table("t", spark.createDataFrame([(i, i, None) for i in range(300)], "k long, v long, r double"), unique=[["k"]])
    meta = engine.manifest["tables"]["t"]
    found = changelog.as_of(spark, meta, buckets=[3])
    assert len(files_read(found)) == 1 and 0 < found.count() < 100
    engine.delete("t", spark.createDataFrame([(7, 7, None)], "k long, v long, r double"))
    with pytest.raises(IllegalChange):
        engine.delete("t", spark.createDataFrame([(7, 7, None)], "k long, v long, r double"))
    engine.insert("t", spark.createDataFrame([(7, 8, None)], "k long, v long, r double"))
    engine.compact("t")
    assert engine.base("t").count() == 300 and len(engine.manifest["tables"]["t"]["snapshot"]) == 16


def cells(spark, rows):
    """Rows of (id, value) as cells by Python type."""
    raw = spark.createDataFrame([(i, "NULL" if v is None else type(v).__name__, v if isinstance(v, int) else None, v if isinstance(v, float) else None, v if isinstance(v, str) else None) for i, v in rows], "id long, c string, i long, r double, t string")
    cell = F.when(F.col("c") == "int", values.int_cell(F.col("i"))).when(F.col("c") == "float", values.real_cell(F.col("r"))).when(F.col("c") == "str", values.text_cell(F.col("t"))).otherwise(values.int_cell(F.lit(None).cast("long")))
    return raw.select("id", cell.alias("k"))


def test_replace_delete_and_update_with_dynamic_columns(spark):
    engine = Engine(spark, buckets=3)
    engine.create_table("t", cells(spark, [(1, 1), (2, "1"), (3, None), (4, 2.5)]), unique=[["k"]])
    engine.create_view("w", "SELECT k, COUNT(*) AS n, SUM(id) AS s FROM t GROUP BY k")
    ids = lambda: sorted(r.id for r in engine.base("t").collect())
    engine.replace("t", cells(spark, [(10, 1.0), (11, None), (12, None)]))  # 1.0 takes the place of 1; NULLs share nothing
    assert ids() == [2, 3, 4, 10, 11, 12]
    with pytest.raises(IllegalChange, match="share the unique key"):
        engine.replace("t", cells(spark, [(20, 7), (21, 7.0)]))
    engine.refresh("w")
    assert {(r.k.c, r.n, r.s) for r in engine.table("w").collect()} == {(values.REAL, 1, 10), (values.TEXT, 1, 2), (values.NULL, 3, 26), (values.REAL, 1, 4)}
    base = engine.base("t")
    engine.delete("t", base.where("id = 11"))
    engine.update("t", base.where("id = 4"), base.where("id = 4").withColumn("id", F.lit(40).cast("long")))
    engine.refresh("w")
    assert ids() == [2, 3, 10, 12, 40]
    assert rows_of(engine.table("w")) == rows_of(engine.recompute("w"))


def test_state_that_contradicts_itself_is_found(spark):
    engine = Engine(spark, buckets=1)
    engine.create_table("t", spark.createDataFrame([("a", 1, 0.5), ("a", 2, None)], T))
    engine.create_view("w", "SELECT k, SUM(r) AS s, MIN(v) AS lo FROM t GROUP BY k")
    view = engine.manifest["views"]["w"]
    paths = view["parts"]["state"]["0"]
    state = spark.read.schema(spark.read.parquet(*paths).schema).parquet(*paths)
    for where, message in ((F.col("p") == 0, "values left|fewer rows"), (F.col("p") != 1, None), ((F.col("p") != 0) | F.lit(False), "values left")):
        kept = state.where(where) if message != "values left|fewer rows" else state.where(F.col("p") != 0)
        path = engine.store.fresh("tampered") + "/__b=0"
        kept.write.parquet(path)
        engine.manifest["views"]["w"]["parts"]["state"]["0"] = [path]
        engine.manifest["tables"]["t"]["segments"], engine.manifest["tables"]["t"]["next"] = [], 1
        engine.manifest["views"]["w"]["applied"]["t"] = 0
        engine.apply("t", spark.createDataFrame([("a", 1, 0.5, -1), ("a", 2, None, -1)], T + f", {W} long"), check=False)
        if message:
            with pytest.raises(StateError):
                engine.refresh("w")
        else:
            with pytest.raises(StateError, match="residue|values left"):
                engine.refresh("w")


CELLS = [1, 1.0, "1", b"1", 0.0, -0.0, 2**53 + 1, float(2**53), 2.5, "2.5", " 7 ", "abc", "1e2", None, -3, b"\x00", 9.5e18, "9223372036854775808"]


def cell(x):
    if x is None:
        return (0, None, None, None, None)
    return {int: lambda: (1, x, None, None, None), float: lambda: (2, None, x, None, None), str: lambda: (3, None, None, x, None), bytes: lambda: (4, None, None, None, bytearray(x))}[type(x)]()


def back(c):
    return {0: lambda: None, 1: lambda: c.i, 2: lambda: c.r, 3: lambda: c.t, 4: lambda: bytes(c.b)}[c.c]()


@pytest.mark.parametrize("where", ["", " WHERE x < 'abc'", " WHERE x >= X'31'", " WHERE x <= 9007199254740993"])
def test_dynamic_values_equal_sqlite(spark, where):
    rng = random.Random(5)
    data = [(rng.choice(CELLS), rng.choice(CELLS)) for _ in range(60)]
    sql = f"SELECT g, COUNT(*) AS n, COUNT(x) AS c, SUM(x) AS s, TOTAL(x) AS t, MIN(x) AS lo, MAX(x) AS hi FROM t{where} GROUP BY g"
    engine = Engine(spark, buckets=2)
    make = lambda rows: spark.createDataFrame([(cell(g), cell(x)) for g, x in rows], zcells)
    from pyspark.sql import types as ST

    zcells = ST.StructType([ST.StructField("g", values.CELL), ST.StructField("x", values.CELL)])
    engine.create_table("t", make(data + [(1, 5)]))
    engine.create_view("w", sql)
    engine.delete("t", make([(1, 5)]))
    engine.refresh("w")
    base = sqlite3.connect(":memory:")
    base.execute("CREATE TABLE t(g, x)")
    base.executemany("INSERT INTO t VALUES (?, ?)", data)
    want = {}
    for g, n, c, s, t, lo, hi in base.execute(sql):
        want[(type(g) if isinstance(g, (str, bytes)) else 0, g)] = (n, c, s, t, lo, hi)
    got = {}
    for r in engine.table("w").collect():
        g = back(r.g)
        got[(type(g) if isinstance(g, (str, bytes)) else 0, g)] = (r.n, r.c, back(r.s), r.t, back(r.lo), back(r.hi))
    assert set(got) == set(want)
    for g, (n, c, s, t, lo, hi) in want.items():
        mine = got[g]
        assert mine[:2] == (n, c) and (mine[4], mine[5]) == (lo, hi)
        assert (s is None) == (mine[2] is None) and (s is None or type(mine[2]) is type(s) and mine[2] == pytest.approx(s, rel=1e-12))
        assert mine[3] == pytest.approx(t, rel=1e-12)


def test_affinity_of_stored_cells(spark):
    from pyspark.sql import types as ST

    schema = ST.StructType([ST.StructField("x", values.CELL)])
    df = spark.createDataFrame([(cell(x),) for x in CELLS], schema)
    base = sqlite3.connect(":memory:")
    for affinity in ("INTEGER", "NUMERIC", "REAL", "BLOB"):
        base.execute(f"CREATE TABLE a_{affinity}(x {affinity})")
        base.executemany(f"INSERT INTO a_{affinity} VALUES (?)", [(x,) for x in CELLS])
        want = [r[0] for r in base.execute(f"SELECT x FROM a_{affinity}")]
        got = [back(r.x) for r in df.select(values.with_affinity(values.clean(F.col("x"), "dyn"), affinity).alias("x")).collect()]
        assert [(type(a), a) for a in got] == [(type(b), b) for b in want], affinity


def test_statements(spark):
    engine = Engine(spark, buckets=2)
    engine.create_table("t", spark.createDataFrame([("a", 1, 0.5)], T))
    engine.sql("CREATE VIRTUAL TABLE w USING ivm('SELECT k, COUNT(*) AS n FROM t WHERE k <> ''q'' GROUP BY k')")
    engine.insert("t", spark.createDataFrame([("a", 1, 0.5)], T))
    assert engine.sql("SELECT n FROM w").first().n == 1
    assert engine.sql("INSERT INTO w(w) VALUES ('refresh')") is True
    assert engine.sql("SELECT n FROM w JOIN t ON w.k = t.k").count() == 2
    assert engine.sql("SELECT refresh_all('continue')") == "refreshed 0, skipped 1, failed 0" and engine.sql("SELECT ivm_refresh_all()") == 0
    for sql, message in [("INSERT INTO w(w) VALUES ('rebuild')", "unknown command"), ("INSERT INTO w(w, k) VALUES ('refresh', 1)", "no other column"), ("INSERT INTO w(k) VALUES ('x')", "read-only"), ("UPDATE w SET k = 'x'", "read-only"), ("DELETE FROM w", "read-only"), ("ALTER TABLE w RENAME TO z", "cannot be renamed"), ("INSERT INTO t SELECT refresh_all()", "insert, delete"), ("SELECT 1 + refresh_all()", "SELECT of its own")]:
        with pytest.raises(ViewError, match=message):
            engine.sql(sql)
    engine.sql("CREATE MATERIALIZED VIEW m AS SELECT k, MAX(v) AS hi FROM t GROUP BY k")
    assert engine.sql("REFRESH MATERIALIZED VIEW m") is False
    engine.sql("DROP MATERIALIZED VIEW m")
    engine.sql("DROP TABLE w;")
    assert engine.manifest["views"] == {}


@pytest.mark.parametrize("renaming", [True, False])
def test_of_two_writers_one_commits(spark, monkeypatch, tmp_path, renaming):
    from driftwell.plans import store

    if not renaming:
        monkeypatch.setattr(store, "_RENAMING", ())
    one, two = (store.Store(spark, f"file://{tmp_path}") for _ in range(2))
    one.load(), two.load()
    one.commit({"tables": {}, "views": {}, "by": 1})
    with pytest.raises(StateError, match="another writer"):
        two.commit({"tables": {}, "views": {}, "by": 2})
    if renaming:  # the other writer wins between the look and the rename
        real, looks = two.fs, iter([False])
        two.fs = type("Blind", (), {"exists": lambda self, p: next(looks, True), "__getattr__": lambda self, n: getattr(real, n)})()
        with pytest.raises(StateError, match="another writer"):
            two.commit({"tables": {}, "views": {}, "by": 2})
    assert store.Store(spark, f"file://{tmp_path}").load()["by"] == 1
