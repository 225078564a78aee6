import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftwell.operators import orphans

T0 = datetime(2021, 3, 1)
at = lambda h: None if h is None else T0 + timedelta(hours=h)


def brute(refs, records):
    there = {}
    for key, arrived, deleted in records:
        if key is None:
            continue
        a, d = there.get(key, (None, None))
        there[key] = (min((x for x in (a, arrived) if x is not None), default=None), min((x for x in (d, deleted) if x is not None), default=None))
    once = {}
    for i, key, made, arrived in refs:
        if i is not None:
            k, m, a = once.get(i, (key, made, arrived))
            once[i] = (k, m, min((x for x in (a, arrived) if x is not None), default=None))
    out = set()
    for i, (key, made, arrived) in once.items():
        if key is None:
            continue
        if key not in there:
            out.add((i, "missing"))
            continue
        a, d = there[key]
        if d is not None and made is not None and d <= made:
            out.add((i, "deleted"))
        elif a is not None and arrived is not None and a > arrived:
            out.add((i, "late"))
    return out


def frames(spark, refs, records):
    r = spark.createDataFrame([(i, k, at(m), at(a), 0) for i, k, m, a in refs], "id long, k long, made timestamp, arrived timestamp, refs long")
    e = spark.createDataFrame([(k, at(a), at(d), "x") for k, a, d in records], "k long, arrived timestamp, deleted timestamp, alive string")
    return (
        orphans.references(r, F.col("id"), F.col("k"), F.col("made"), F.col("arrived")),
        orphans.existence_delta(e, F.col("k"), F.col("arrived"), F.col("deleted")),
    )


def scene(seed, n):
    rng = random.Random(seed)
    pick = lambda p, f: None if rng.random() < p else f()
    records = [(pick(0.05, lambda: rng.randrange(30)), pick(0.05, lambda: rng.randrange(50)), pick(0.7, lambda: rng.randrange(60))) for _ in range(40)]
    refs = []
    for i in range(n):
        row = (i, pick(0.1, lambda: 3 if rng.random() < 0.4 else rng.randrange(45)), pick(0.05, lambda: rng.randrange(60)))
        refs += [(*row, pick(0.05, lambda: rng.randrange(60))) for _ in range(1 + (rng.random() < 0.2))]
    return refs, records


def test_rows_equal_brute_force(spark):
    for seed in range(3):
        refs, records = scene(seed, 150)
        found, _ = orphans.find_orphans(*frames(spark, refs, records))
        assert {(r.row_id, r.reason) for r in found.collect()} == brute(refs, records)


def test_state_is_the_same_in_any_batching(spark):
    refs, records = scene(9, 80)
    rows, there = frames(spark, refs, records)
    whole = orphans.fold(orphans.reference_delta(rows), there)
    state = None
    for part in range(3):
        delta = orphans.fold(orphans.reference_delta(rows.where(F.col("row_id") % 3 == part)), there.where(F.pmod("ref_key", F.lit(3)) == part))
        state = delta if state is None else orphans.fold(state, delta)
    assert sorted(map(str, whole.collect())) == sorted(map(str, state.collect()))
    gone = orphans.fold(state, orphans.reference_delta(rows, -1))
    assert orphans.current_orphans(gone).count() == 0


def test_current_orphans_come_and_go(spark):
    rows, there = frames(spark, [(1, 7, 1, 1), (2, 7, 1, 1), (3, 8, 1, 1)], [(8, 0, None)])
    state = orphans.fold(orphans.reference_delta(rows), there)
    assert [(r.ref_key, r.refs) for r in orphans.current_orphans(state).collect()] == [(7, 2)]
    _, arrives = frames(spark, [], [(7, 5, None)])
    assert orphans.current_orphans(orphans.fold(state, arrives)).count() == 0


def test_empty_tables(spark):
    found, state = orphans.find_orphans(*frames(spark, [], []))
    assert found.count() == 0 and state.count() == 0
    found, _ = orphans.find_orphans(*frames(spark, [(1, 1, 1, 1)], []))
    assert [(r.row_id, r.reason) for r in found.collect()] == [(1, "missing")]


def test_hot_missing_key(spark):
    refs = [(i, 99, 1, 1) for i in range(400)]
    found, _ = orphans.find_orphans(*frames(spark, refs, []))
    assert found.count() == 400
