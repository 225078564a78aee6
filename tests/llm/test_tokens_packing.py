import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.llm import packing, tokens


def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.TOKENIZER, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(" \t\n\x0b\x0c\r\x1c\x1f'srtvemld aA1_-", max_size=80)))
def test_counts_equal_the_encoder(text):
    assert tokens.counter().count(text) == len(encoder.encode_ordinary(text))


encoder = encoding()


def test_edge_texts():
    count = tokens.counter().count
    assert count(None) == count("") == 0
    for text in ("x" * 3000, "a b " * 50_000, "\n" * 5000, "ä" * 2000, "it's we'll 12345 ----\r\n\t end"):
        assert count(text) == len(encoder.encode_ordinary(text))


def test_column(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "id long, t string")
    assert [r.n for r in df.select("id", tokens.n_tokens(F.col("t")).alias("n")).orderBy("id").collect()] == [2, 0, 0]


def test_best_fit_with_a_fixed_number_of_windows():
    w = packing.OpenWindows(10, 2, 0)
    assert [w.place(x) for x in (6, 7, 3, 4)] == [0, 1, 1, 0]  # 3 fits window 1 exactly, 4 window 0
    assert w.place(5) == 2 and len(w.open) == 2  # the fullest was emitted
    assert packing.split(25, 10) == [10, 10, 5] and packing.split(20, 10) == [10, 10] and packing.split(0, 10) == [0] and packing.split(10, 10) == [10]


@pytest.mark.parametrize("windows,fan_in", [(1, 2), (4, 2), (64, 64)])
def test_every_part_is_placed_and_nothing_overflows(spark, windows, fan_in):
    rng = random.Random(windows)
    texts = [(i, " a" * min(400, int(rng.expovariate(0.03)))) for i in range(400)] + [(900, None), (901, ""), (902, " a" * 64), (903, " a" * 65), (904, " a" * 640), (904, " a" * 3), (None, " a")]
    df = spark.createDataFrame(texts, "doc long, t string").withColumn("window", F.lit("clash")).withColumn("room", F.lit(0)).repartition(7)
    got = packing.pack(df, F.col("doc"), F.col("t"), 64, windows, fan_in).collect()
    assert sum(r.part_tokens for r in got) == sum(len(t or "") // 2 for _, t in texts)
    used = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.part_tokens
    assert max(used.values()) <= 64
    parts = {}
    for r in got:
        parts.setdefault((r.item_id, r.n_tokens), []).append(r.part_tokens)
    for (item, n), sizes in parts.items():
        if n <= 64:
            assert set(sizes) == {n}  # never split
        else:
            assert sum(sizes) % n == 0 and sorted(sizes)[-1] == 64
    assert {r.item_id for r in got} == {i for i, _ in texts}
    room = len(used) * 64 - sum(used.values())
    if windows == 64:
        assert room < 0.1 * len(used) * 64
    report = packing.fill_report(packing.pack(df, F.col("doc"), F.col("t"), 64, windows, fan_in), 64).first()
    assert report.fullest <= 64 and report.tokens == sum(used.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc long, t string")
    packed = packing.pack(df, F.col("doc"), F.col("t"))
    assert packed.count() == 0
    assert packing.fill_report(packed).first().containers == 0
