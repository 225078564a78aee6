import pytest
from pyspark.sql import functions as F

from driftwell.llm import mixing


def tokens_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("bucket_rows", [10, 10_000])
def test_shares_repeats_and_positions(spark, bucket_rows):
    rows = [(i, "a", 5 + i % 7) for i in range(900)] + [(1000 + i, "b", 3) for i in range(40)] + [(2000, None, 500), (2001, "other", 500), (2002, "a", 0)]
    t = tokens_of(spark, rows)
    d = mixing.demands(t, targets(spark, [(" A ", 0.5, 1), ("b", 0.05, 4), ("c", 0.1, 2), ("b_x", 0.0, 1)]))
    whole = sum(r[2] for r in rows)
    sel = mixing.selection(t, d, bucket_rows=bucket_rows)
    got = sel.collect()
    for source, share, repeats in (("a", 0.5, 1), ("b", 0.05, 4)):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.n_tokens for r in mine) - share * whole) <= 6
        assert len({(r.doc_id, r.copy_no) for r in mine}) == len(mine) and max(r.copy_no for r in mine) <= repeats
        assert all(0 <= r.position <= 1 for r in mine)
        uses = {}
        for r in mine:
            uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
        assert max(uses.values()) - min(uses.values()) <= 1 or source == "a"
        order = sorted(r.position for r in mine)
        assert abs(order[len(order) // 2] - 0.5) < 0.05  # constant weight: even over the training
    report = {r.source: r for r in mixing.mixing_report(sel, d).collect()}
    assert not report["c"].reached and report["a"].reached and report["b"].reached and report["c"].source_tokens == report["c"].selected_tokens == 0
    assert report["a"].share_of_all == pytest.approx(0.5, abs=0.01) and sum(r.share_of_selection for r in report.values()) == pytest.approx(1)


def test_a_source_that_falls_short_is_used_up(spark):
    t = tokens_of(spark, [(i, "a", 10) for i in range(5)] + [(9, "z", 950)])
    d = mixing.demands(t, targets(spark, [("a", 0.5, 3)]))
    assert not mixing.mixing_report(mixing.selection(t, d), d).first().reached
    assert mixing.selection(t, d).groupBy("doc_id").count().where("count = 3").count() == 5


@pytest.mark.parametrize("share,repeats,reached", [(0.05, 1, True), (0.0501, 1, False), (0.15, 3, True), (0.1499, 3, True), (0.1501, 3, False)])
def test_what_the_selection_says_of_a_source_near_its_limit(spark, share, repeats, reached):
    t = tokens_of(spark, [(i, "a", 10) for i in range(5)] + [(9, "z", 950)])
    d = mixing.demands(t, targets(spark, [("a", share, repeats)]))
    assert mixing.mixing_report(mixing.selection(t, d), d).first().reached is reached


def test_selection_is_the_same_in_any_partitioning(spark):
    t = tokens_of(spark, [(i, "a", 1 + i % 9) for i in range(500)])
    d = mixing.demands(t, targets(spark, [("a", 0.3, 1)]))
    one, two = (sorted(map(tuple, mixing.selection(x, d, bucket_rows=20).collect())) for x in (t, t.repartition(5, "n_tokens")))
    assert one == two


def test_the_curriculum_shapes_the_positions(spark):
    t = tokens_of(spark, [(i, s, 4) for s in ("up", "steps") for i in range(1000)])
    d = mixing.demands(t, targets(spark, [("up", 0.4, 1), ("steps", 0.4, 1)]))
    schedule = {"up": [(0.0, 0.0), (1.0, 2.0)], "steps": [(0.0, 1.0), (0.5, 1.0), (0.500001, 0.0), (1.0, 0.0)]}
    got = mixing.selection(t, d, schedule=schedule)
    share = lambda s, upto: got.where((F.col("source") == s) & (F.col("position") <= upto)).count() / got.where(F.col("source") == s).count()
    assert share("up", 0.5) == pytest.approx(0.25, abs=0.01) and share("up", 0.9) == pytest.approx(0.81, abs=0.01)
    assert share("steps", 0.25) == pytest.approx(0.5, abs=0.01) and share("steps", 0.51) == 1
    ordered = [r.position for r in mixing.in_training_order(got).collect()]
    assert ordered == sorted(ordered)
    for bad in ([(0.0, 1.0)], [(0.1, 1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0)], [(0.0, -1.0), (1.0, 2.0)]):
        with pytest.raises(ValueError):
            mixing.curves({"x": bad})


def test_whole_documents(spark):
    df = spark.createDataFrame([(1, "S_x", "one two", 0), (2, " s-X", None, 0), (3, "", "three", 0)], "doc_id long, source string, text string, n_tokens int")
    sel, d = mixing.mix(df, F.col("doc_id"), F.col("source"), F.col("text"), targets(spark, [("s-x", 0.5, 1), (None, 0.5, 1)]))
    assert d.count() == 1 and d.first().source_tokens == 2
    assert [(r.source, r.doc_id) for r in sel.where("n_tokens > 0").collect()] in ([], [("s-x", 1)])


def test_empty_tables(spark):
    t = tokens_of(spark, [])
    d = mixing.demands(t, targets(spark, [("a", 0.5, 1)]))
    assert mixing.selection(t, d).count() == 0 and mixing.mixing_report(mixing.selection(t, d), d).first().reached
    assert mixing.demands(t, targets(spark, [])).count() == 0
