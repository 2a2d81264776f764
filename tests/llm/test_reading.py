import random
from datetime import datetime

import numpy as np

from tallywright.llm import reading as R

LEVELS = [
    ["the dog must sit by the door and the cat can run to the tree", "you can go home now with the bag", "we will get the red ball for you"],
    ["when the teacher will open the book we could read the story to the class", "my friend had to find the ticket before the train could leave"],
    ["the office should confirm the application after the department has updated the document", "each student plans to submit the request through the online system"],
    ["the committee is expected to evaluate the institutional requirement in accordance with the applicable regulations and the assessment framework"],
    ["the epistemological indeterminacy of the operationalisation presupposes the ontological irreversibility of the jurisdictional recontextualisation and its proportionality"],
]


def text(rng, band, n=12):
    return ". ".join(rng.choice(LEVELS[min(4, max(0, band - 1 + (rng.random() < 0.12) - (rng.random() < 0.12)))]).capitalize() for _ in range(n)) + "."


def words(s):
    return [w for line in R.prose(s) for w in line]


def test_prose_leaves_out_what_is_none():
    s = "RE: your request\n<p>The desk must sign&nbsp;the form today.</p>\nstu_code,stu_surn,sce_ayrc,amount\nS039054270,Khupa,2021/3,W,7073.47\n2024-05-08T06:08:49Z ERROR [loader-2] batch=3756 rows=80125\nSELECT s.stu_code, COUNT(*)\n  FROM stu s JOIN sce c ON c.sce_stuc = s.stu_code\nARTX100\tX125\tY\n{\"rule\":\"QA-498\",\"n\":44}\n* Thank you\nWe went by registered pos-\nt to the old hou-\nse.\n--\nStudent Records\nTel: 01632 960766"
    assert words(s) == "the desk must sign the form today thank you we went by registered post to the old house".split()
    assert words("WHERE THE OFFICE IS EXPECTED TO ACT, THE RECORD OF THE STUDENT IS OPEN.")[0] == "where"
    assert words("") == [] and words("​ ") == []


def test_english():
    known = dict.fromkeys("the office will confirm a student form".split(), 1.0)
    assert R.english([["the", "office", "will", "confirm"], "bydd y tim cyllid yn ateb o fewn deg diwrnod".split()]) == ["the", "office", "will", "confirm"]
    assert R.english([["thank", "you"], ["the", "form"]], known) == ["the", "form"]


def tables(spark, rng, n, rated):
    docs = [(i, text(rng, 1 + i % 5), "de", "x") for i in range(n)]
    extra = [(n, None, "en", "x"), (n + 1, "", "en", "x"), (n + 2, "  \n ", "en", "x"), (n + 3, "Too short to grade, this is.", "en", "x"), (n + 4, "Bydd y tîm cyllid yn ateb o fewn deg diwrnod. " * 20, "en", "x"), (n + 5, text(rng, 3) * 200, None, "x")]
    labels = [(i, f"r{k}", max(1, min(5, 1 + i % 5 + (rng.random() < 0.1) - (rng.random() < 0.1))), datetime(2024, 1, 1)) for i in range(rated) for k in range(rng.choice([1, 2, 3]))]
    labels += [(0, "r0", None, datetime(2024, 2, 1)), (1, "r9", 9, datetime(2024, 2, 1)), (999_999, "r1", 2, None), (None, "r1", 2, None)]
    return spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, words string"), spark.createDataFrame(labels, "doc_id long, rater string, band int, rated_at timestamp")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark, random.Random(2), 300, 150)
    got = {r["doc_id"]: r["reading_band"] for r in R.reading_bands(docs, labels).collect()}
    held = range(150, 300)
    assert np.mean([got.get(i) == 1 + i % 5 for i in held]) > 0.9
    assert set(got) == {*range(300), 305} and got[305] == 3


def test_nothing_rated_or_nothing_there(spark):
    docs, labels = tables(spark, random.Random(3), 10, 5)
    assert R.reading_bands(docs, labels.limit(0)).count() == 0
    assert R.reading_bands(docs.limit(0), labels).count() == 0


def test_ratings(spark):
    rows = [(1, "a", 2, datetime(2024, 1, 1)), (1, "a", 3, datetime(2024, 1, 2)), (1, "b", 2, None), (1, "c", None, datetime(2024, 1, 1)), (2, "a", 6, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "doc_id long, rater string, band int, rated_at timestamp")
    assert [tuple(r) for r in R.ratings(df).collect()] == [(1, [2, 3])]
