import pytest
from pyspark.sql import functions as F

from driftwell.llm import reading
from driftwell.llm.prose import sentences

EASY = "The big dog ran to the red box. We can see the cat."
HARD = "Notwithstanding the preliminary characterization, administrative accountability necessitates comprehensive documentation. Considerable methodological sophistication characterizes contemporary investigations."

LOG = """commit 0123456789abcdef0123456789abcdef01234567
Author: A B <a@b.test>
Date:   Mar 1 2021

    subject with several more words here

    First line of prose that
    wraps here. Second sentence stands here!

      * an item without a stop
      * another item that goes
        over two lines
      1) a third one comes here

        at foo_bar(baz.c:12)
        $ ./run --now=1
    See https://tracker.example/a/b#c
      5a97ba67a5526fcbbfd28a89de87f733a8e80af8  merge_queue
    Signed-off-by: A B <a@b.test>
    Fixes: #12

diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +1,2 @@
-This is not prose at all here.
"""


def test_prose_of_a_log_entry():
    assert [" ".join(s) for s in sentences(LOG)] == [
        "first line of prose that wraps here",
        "second sentence stands here",
        "an item without a stop",
        "another item that goes over two lines",
        "a third one comes here",
    ]


@pytest.mark.parametrize(
    "text",
    [
        "From 01 Mar 1\nFrom: A <a@b.c>\nSubject: [PATCH 1/2] a subject that\n folds over lines\n\nOnly this sentence counts here.\n---\n 2 file(s) changed\n\ndiff --git a/x b/x\n",
        "# HG changeset patch\n# User A <a@b.c>\n# Node ID 01\na subject of its own\n\nOnly this sentence counts here.\n\nReview-Id: R12\n\ndiff -r 1 -r 2 x\n+nothing from here on counts\n",
        "-----------\nr12 | a | Mar 1 | 3 lines\n\na subject of its own\n\nOnly this sentence counts here.\n\nIndex: x\n======\n",
        "a bare subject line\n\nOnly this sentence counts here.",
    ],
)
def test_prose_of_the_other_layouts(text):
    assert [" ".join(s) for s in sentences(text)] == ["only this sentence counts here"]


def test_automatic_messages_and_empty_texts_have_no_prose():
    bump = "commit 01\n\n    Bump a-b from 1 to 2\n\n    ---\n    updated-dependencies:\n    - dependency-name: a-b\n      update-type: minor\n    ...\n\n    Signed-off-by: A\n"
    for text in (None, "", "\n", "commit 01", bump, "diff --git a/x b/x\n+This is some code text.\n", "commit 1\n\n    s\n\n    This reverts commit 7fac97bb79b881ee54576fc0f8004bc2693e2bf9.\n"):
        assert sentences(text) == []


def corpus(n):
    words_easy, words_hard = EASY.replace(".", "").split(), HARD.replace(".", "").replace(",", "").split()
    docs = []
    for i in range(n):
        words = words_easy if i % 2 else words_hard
        body = ". ".join(" ".join(words[(i * 3 + j * 5 + k * 7) % len(words)] for k in range(9)) for j in range(3)) + "."
        docs.append((i, f"subject line\n\n{body}"))
    return docs


def test_held_out_accuracy_with_wrong_labels(spark):
    docs = corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = [(i, (3 if i % 2 else 18)) for i in range(0, 100)]
    labels = [(i, 18 if i % 10 == 1 else g) for i, g in labels] + [(2, None), (4, 99), (4, 17), (777, 3)]
    labels = spark.createDataFrame(labels, "doc_id long, grade int")
    prose = reading.prose_table(df, F.col("doc_id"), F.col("text"))
    seeds = reading.seed_levels(prose, labels).join(labels.select("doc_id").distinct(), "doc_id")
    model = reading.train(seeds)
    got = {r.doc_id: r.level for r in reading.assign(prose.where("doc_id >= 100"), model).collect()}
    right = sum(level == (0 if i % 2 else 3) for i, level in got.items())
    assert len(got) == 100 and right >= 98


def test_levels_with_formula_seeds_only(spark):
    df = spark.createDataFrame([(1, f"s\n\n{EASY}"), (2, f"s\n\n{HARD}"), (3, None), (4, ""), (None, f"s\n\n{EASY}")], "doc_id long, text string").withColumn("level", F.lit("clash")).withColumn("sentences", F.lit(1))
    got = {r.doc_id: r for r in reading.reading_levels(df, F.col("doc_id"), F.col("text")).collect()}
    assert (got[1].level, got[2].level, got[2].n_above, got[1].n_above) == (0, 3, 2, 0)
    assert got[3].level is None and got[4].n_sentences == 0 and got[None].level == 0


def test_unknown_words_fall_back_on_the_formula(spark):
    df = spark.createDataFrame([(1, f"s\n\n{EASY}")], "doc_id long, text string")
    prose = reading.prose_table(df, F.col("doc_id"), F.col("text"))
    model = reading.train(reading.seed_levels(prose, None).limit(0))
    row = reading.assign(prose, model).first()
    assert row.level == 0 and row.posterior is None


def test_long_simple_sentences_are_not_hard(spark):
    text = "s\n\n" + " and then ".join(["we can see the dog in the big red box"] * 8) + "."
    docs = corpus(60) + [(1000 + i, f"s\n\n{EASY}") for i in range(40)]
    df = spark.createDataFrame([(5000, text), *docs], "doc_id long, text string")
    assert reading.formula_grade(sentences(text)) > 13
    labels = spark.createDataFrame([(1000 + i, 3) for i in range(40)], "doc_id long, grade int")
    got = {r.doc_id: r.level for r in reading.reading_levels(df, F.col("doc_id"), F.col("text"), labels).collect()}
    assert got[5000] == 0 and got[0] == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert reading.reading_levels(df, F.col("doc_id"), F.col("text")).count() == 0


@pytest.mark.parametrize("vocabulary", [0, 1, 7])
def test_words_beyond_the_vocabulary_count_all_the_same(spark, vocabulary):
    docs = corpus(40) + [(1000, None), (1001, f"s\n\n{EASY}"), (1001, f"s\n\n{HARD}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prose = reading.prose_table(df, F.col("doc_id"), F.col("text"))
    seeds = reading.seed_levels(prose, None)
    whole, cut = reading.train(seeds), reading.train(seeds, vocabulary=vocabulary)
    assert whole.rare is None and len(cut.words) == vocabulary and cut.rare.count() == len(whole.words) - vocabulary > 0
    key = lambda r: (r.doc_id, r.level is None, r.level or 0, r.n_above)
    a, b = (sorted(reading.assign(prose, m).collect(), key=key) for m in (whole, cut))
    assert len(a) == len(b) == 43
    for x, y in zip(a, b):
        assert (x.doc_id, x.level, x.n_sentences, x.n_above) == (y.doc_id, y.level, y.n_sentences, y.n_above)
        assert x.posterior == y.posterior is None or x.posterior == pytest.approx(y.posterior, rel=1e-9)


def test_least_words_and_grades_are_parameters(spark):
    assert sentences("s\n\nToo short. This one has five words.", least_words=2) == [["too", "short"], ["this", "one", "has", "five", "words"]]
    df = spark.createDataFrame([(1, f"s\n\n{EASY}")], "doc_id long, text string")
    prose = reading.prose_table(df, F.col("doc_id"), F.col("text"))
    labels = spark.createDataFrame([(1, 25)], "doc_id long, grade int")
    assert reading.seed_levels(prose, labels).first().grade < 5 and reading.seed_levels(prose, labels, grades=(1, 30)).first().grade == 25
