"""Enumerated views against sqlite3 and an exact sum after every batch of random changes.

The space is every combination of keys, aggregates and predicate over two databases, one with a declared type per column and
one with dynamic cells, and joins of both tables. A run takes a seeded sample; DRIFTWELL_VIEWS=all takes every view.
"""

import itertools
import os
import random
import sqlite3
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from driftwell.engine import Engine
from driftwell.functions import values
from driftwell.operators.zset import W

KEYS = ["k", "v", "k, v"]
AGGREGATES = ["COUNT(*)", "COUNT({c})", "SUM({c})", "TOTAL({c})", "AVG({c})", "MIN({c})", "MAX({c})"]
COLUMNS = ["k", "v", "x"]
PREDICATES = ["", "v > 1", "2 >= v", "v <> 2", "v = '2'", "k = 'v1'", "k < 'v2'", "x IS NULL", "x IS NOT NULL", "x >= 2", "x <> 2.5", "v < 'abc'"]
POOL = {
    "k": ["v0", "v1", "v2", "12", "1.5", " 7 ", None],
    "v": [0, 1, 2, 3, 2**53 + 1, -(2**53), None],
    "x": [0.1, 0.2, 2.5, -0.25, 1e15 + 0.5, 1e300, -1e300, 5e-324, 2.0, None],
    "cell": [0, 1, 2, 1.0, -0.0, 2.5, "3", "1.5", "v1", b"\x00", b"12", 2**53 + 1, 0.1, "12abc", None],
}
TYPED = [("k", ST.StringType()), ("v", ST.LongType()), ("x", ST.DoubleType())]


def single():
    """(keys, SELECT text) of every view over one table."""
    for keys, where in itertools.product(KEYS, PREDICATES):
        for a, c in itertools.product(AGGREGATES, COLUMNS):
            if a == "COUNT(*)" and c != COLUMNS[0]:
                continue
            yield keys, f"SELECT {keys}, {a.format(c=c)} AS a, COUNT(*) AS n FROM t" + (f" WHERE {where}" if where else "") + f" GROUP BY {keys}"


def joins():
    for on, (a, c), where in itertools.product(COLUMNS, itertools.product(AGGREGATES, COLUMNS), PREDICATES):
        if a != "COUNT(*)" or c == COLUMNS[0]:
            yield "k", f"SELECT t.k, {a.format(c='u.' + c)} AS a, COUNT(*) AS n FROM t JOIN u ON t.{on} = u.{on}" + (f" WHERE {where.replace('2 >= v', '2 >= t.v') if where[0] == '2' else 't.' + where}" if where else "") + " GROUP BY t.k"


def picked(space, n, seed):
    every = list(space)
    return every if os.environ.get("DRIFTWELL_VIEWS") == "all" else random.Random(seed).sample(every, n)


def cell(x):
    kind = {type(None): 0, int: 1, float: 2, str: 3, bytes: 4}[type(x)]
    return (kind, *[x if kind == i else None for i in range(1, 5)])


def plain(x):
    """A value of a result row as Python sees it."""
    if isinstance(x, ST.Row):
        x = [None, x.i, x.r, x.t, None if x.b is None else bytes(x.b)][x.c]
    return bytes(x) if isinstance(x, bytearray) else x


def key_of(x):
    """What sqlite3 groups by: numbers by value, text and blobs apart."""
    return (type(x).__name__, x) if isinstance(x, (str, bytes)) or x is None else ("number", Fraction(x))


def same(a, b, scale):
    if a is None or b is None or isinstance(b, (str, bytes)):
        return a == b
    if isinstance(b, int) and isinstance(a, int):
        return a == b
    return abs(Fraction(a) - Fraction(b)) <= Fraction(4 * 2.0**-52) * scale if abs(a) != float("inf") else a == b


class Database:
    def __init__(self, spark, dynamic, tables, rng):
        self.spark, self.dynamic, self.rng = spark, dynamic, rng
        self.live = {t: [self.row() for _ in range(25)] for t in tables}
        self.engine, self.lite = Engine(spark, buckets=2), sqlite3.connect(":memory:")
        for t in tables:
            self.engine.create_table(t, self.frame(self.live[t]))
            self.lite.execute(f"CREATE TABLE {t}(k, v, x)" if dynamic else f"CREATE TABLE {t}(k TEXT, v INTEGER, x REAL)")
            self.lite.executemany(f"INSERT INTO {t} VALUES (?, ?, ?)", self.live[t])

    def row(self):
        return tuple(self.rng.choice(POOL["cell" if self.dynamic else c]) for c in COLUMNS)

    def frame(self, rows, weight=None):
        fields = [ST.StructField(c, values.CELL if self.dynamic else kind) for c, kind in TYPED]
        data = [tuple(map(cell, r)) if self.dynamic else r for r in rows]
        df = self.spark.createDataFrame(data, ST.StructType(fields))
        return df if weight is None else df.withColumn(W, F.lit(weight).cast("long"))

    def change(self):
        for t, rows in self.live.items():
            gone = [rows.pop(self.rng.randrange(len(rows))) for _ in range(self.rng.randrange(1, 9))]
            came = [self.row() for _ in range(self.rng.randrange(1, 9))]
            rows += came
            self.engine.apply(t, self.frame(gone, -1).unionByName(self.frame(came, 1)))
            self.lite.execute(f"DELETE FROM {t}")
            self.lite.executemany(f"INSERT INTO {t} VALUES (?, ?, ?)", rows)

    def compare(self, name, sql, n_keys):
        got, want = {}, {}
        for r in self.engine.table(name).collect():
            row = [plain(x) for x in r]
            key = tuple(map(key_of, row[:n_keys]))
            assert key not in got, f"{sql}: group {key} twice"
            got[key] = row[n_keys:]
        for row in self.lite.execute(sql):
            want[tuple(map(key_of, row[:n_keys]))] = list(row[n_keys:])
        assert got.keys() == want.keys(), sql
        summed = any(a in sql for a in ("SUM(", "TOTAL(", "AVG("))  # sqlite3 rounds at every addition
        scale = Fraction(0) if not summed else Fraction(10) ** 303 if "x)" in sql and not self.dynamic else Fraction(10) ** 19
        for key, (a, n) in want.items():
            assert got[key][1] == n and same(got[key][0], a, scale), f"{sql}: {key} gave {got[key]}, sqlite3 {(a, n)}"

    def exact(self, name, sql):
        """SUM, TOTAL and AVG of a typed column bit for bit, without any code of the engine."""
        for r in self.engine.table(name).collect():
            mine = [x for k, v, x in self.live["t"] if k == r.k and x is not None]
            whole = sum(map(Fraction, mine))
            assert (r.s, r.t, r.a) == ((float(whole), float(whole), float(whole / len(mine))) if mine else (None, 0.0, None)), sql


@pytest.mark.parametrize("dynamic,joined,seed", [(False, False, 1), (True, False, 2), (False, True, 3)])
def test_views_equal_sqlite_after_every_batch(spark, dynamic, joined, seed):
    rng = random.Random(seed)
    base = Database(spark, dynamic, ["t", "u"] if joined else ["t"], rng)
    views = picked(joins() if joined else single(), 5, seed)
    if not dynamic and not joined:
        views.append(("k", "SELECT k, SUM(x) AS s, TOTAL(x) AS t, AVG(x) AS a FROM t GROUP BY k"))
    for i, (_, sql) in enumerate(views):
        base.engine.create_view(f"w{i}", sql)
    for batch in range(3):
        if batch:
            base.change()
            assert base.engine.refresh_all() == len(views)
        for i, (keys, sql) in enumerate(views):
            if " AS s," in sql:
                base.exact(f"w{i}", sql)
            else:
                base.compare(f"w{i}", sql, 1 + keys.count(","))


def test_a_plain_aggregation_of_the_tables_agrees(spark):
    """The engine's counts and integer sums against Spark's own, over the same base."""
    base = Database(spark, False, ["t"], random.Random(7))
    base.engine.create_view("w", "SELECT k, COUNT(*) AS n, COUNT(v) AS c, SUM(v) AS s, MIN(v) AS lo, MAX(x) AS hi FROM t GROUP BY k")
    base.change()
    base.engine.refresh("w")
    own = base.engine.base("t").groupBy("k").agg(F.count("*").alias("n"), F.count("v").alias("c"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("x").alias("hi"))
    assert Counter(map(tuple, base.engine.table("w").collect())) == Counter(map(tuple, own.collect()))


def test_the_harness_catches_a_lost_retraction(spark, monkeypatch):
    base = Database(spark, False, ["t"], random.Random(9))
    sql = "SELECT k, COUNT(*) AS a, COUNT(*) AS n FROM t GROUP BY k"
    base.engine.create_view("w", sql)
    apply = base.engine.apply
    monkeypatch.setattr(base.engine, "apply", lambda t, delta: apply(t, delta.where(F.col(W) > 0)))
    base.change()
    base.engine.refresh("w")
    with pytest.raises(AssertionError):
        base.compare("w", sql, 1)


def test_size_of_the_space():
    assert len(list(single())) >= 510 and len(list(joins())) >= 399
