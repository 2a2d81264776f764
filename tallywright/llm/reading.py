"""Reading level of English prose from the grades at which its words are acquired."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.session import cut

BANDS, FOLDS = 5, 4
#: Words of running English a document must have to be graded.
MIN_WORDS = 50
#: Words that hold at least this share of the graded text get a grade: at most 1 / LEAST_SHARE words.
LEAST_SHARE = 1 / 200_000
#: Rated documents, by hash of their id, on which the calibration is fitted. Word statistics are over all.
FIT_DOCS = 20_000
QUANTILES = np.linspace(0.05, 0.95, 13)
#: A rating further than this from what the words say gives way.
FAR = 0.9
RIDGE = 0.3
#: Words that hold English sentences together.
FUNCTION_WORDS = frozenset(
    "a about after all also an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it its "
    "may more most must my no nor not now of on once one only or other our out shall she should since so some such than that the their them then there these they "
    "this those though through to too under unless until up upon was we were what when where whereas which while who will with would you your".split()
)

_ZERO = re.compile("[­​-‏⁠﻿]")
_TAG = re.compile(r"<[a-zA-Z/!][^<>]{0,300}>")
_SIGNATURE = re.compile(r"(?m)^\s*--\s*$")
_WRAP = re.compile(r"(?<=\w)-\n(?=\w)")
_DATA = re.compile(r"""^\s*(\d{4}-\d\d-\d\d[T ]\d|[{\[]\s*"|(SELECT|FROM|WHERE|AND|GROUP BY|ORDER BY|LEFT JOIN|INNER JOIN|JOIN)\b(?=.*\w_\w))|\t[^\t]*\t|(,[^\s,]+){3,}|\|.*\|""")
_MARK = re.compile(r"^\s*(?:[-*•–>]+|\d+[.)])\s+")
_NUMBERED = re.compile(r"^\s*\d")
_STOP = re.compile(r"""[.!?]["')\]]*\s*$""")
_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?")


def prose(text: str) -> list[list[str]]:
    """The words of the running text, by line: without markup, headings, signatures and blocks of data."""
    t = _TAG.sub("\n", html.unescape(text))
    t = unicodedata.normalize("NFKC", _ZERO.sub("", t)).replace("\r\n", "\n").replace("\r", "\n").replace("’", "'")
    t = _WRAP.sub("", _SIGNATURE.split(t)[0])
    out, goes_on = [], False
    for line in t.split("\n"):
        s = line.strip()
        if not s or _DATA.search(line):
            goes_on = False
            continue
        words = _WORD.findall(s.lower())
        listed = _MARK.match(line) and not _NUMBERED.match(line)
        heading = not goes_on and not listed and len(words) <= 5 and not _STOP.search(s)
        if heading or sum(c.isdigit() for c in s) > len(s) / 4:
            continue
        out.append(words)
        goes_on = len(s) > 40 and not _STOP.search(s)
    return out


def english(lines: list[list[str]], known: dict[str, float] | None = None) -> list[str]:
    """The words of the lines that are English: held together by English words and, where known is given, half of them known."""
    out: list[str] = []
    for words in lines:
        n = len(words)
        if n >= 4 and sum(w in FUNCTION_WORDS for w in words) < 0.12 * n:
            continue
        if known is not None and 2 * sum(w in known for w in words) < n:
            continue
        out += words
    return out


def quantiles(words: list[str], grades: dict[str, float]) -> np.ndarray | None:
    """The quantiles and the mean of the grades of a text's known words; null below ten of these."""
    x = [grades[w] for w in words if w in grades]
    return np.append(np.quantile(x, QUANTILES), np.mean(x)) if len(x) >= 10 else None


@dataclass
class Calibration:
    """From quantiles of word grades to a band: a ridge regression, then cuts between neighbouring bands."""

    weights: np.ndarray
    cuts: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Calibration:
        """y: the median rating, weight: how many raters. Where nothing was rated a constant model results."""
        if not len(x):
            return cls(np.append((BANDS + 1) / 2, np.zeros(len(QUANTILES) + 1)), np.arange(1, BANDS) + 0.5)
        a = np.column_stack([np.ones(len(x)), x])
        w = np.linalg.solve((a * weight[:, None]).T @ a + RIDGE * np.diag(np.append(0, np.ones(x.shape[1]))), (a * weight[:, None]).T @ y)
        p = a @ w
        cuts = []
        for b in range(1, BANDS):
            grid = np.linspace(b, b + 1, 101)
            clear = y != b + 0.5
            wrong = np.array([(weight * ((p > g) != (y > b + 0.5)))[clear].sum() for g in grid])
            cuts.append(grid[wrong == wrong.min()].mean())
        return cls(w, np.maximum.accumulate(cuts))

    def level(self, x: np.ndarray) -> float:
        return float(self.weights[0] + x @ self.weights[1:])

    def band(self, x: np.ndarray) -> int:
        return 1 + int((self.level(x) > self.cuts).sum())


def ratings(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, bands): each rater's last band for a document. Null bands and bands outside 1 to BANDS are no ratings."""
    given = labels.where(F.col("band").between(1, BANDS)).groupBy(id_col, "rater").agg(F.max_by("band", F.struct("rated_at", "band")).alias("band"))
    return given.groupBy(id_col).agg(F.sort_array(F.collect_list("band")).alias("bands"))


def word_shares(graded: DataFrame) -> list[dict[str, np.ndarray]]:
    """For each fold the words' shares of the text of each band, summed over the documents of all other folds; last over all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[int, str], np.ndarray] = {}
            for fold, bands, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                share = np.bincount(bands, minlength=BANDS + 1)[1:] / len(bands) / max(1, len(words))
                for w, n in Counter(words).items():
                    k = (fold, w)
                    sums[k] = sums[k] + n * share if k in sums else n * share
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums]), *[pa.array([v[i] for v in sums.values()]) for i in range(BANDS)]], names=["fold", "word", *[f"b{i}" for i in range(BANDS)]])

    parts = graded.select("fold", "bands", "words").mapInArrow(count, "fold int, word string, " + ", ".join(f"b{i} double" for i in range(BANDS)))
    by_word = parts.groupBy("word").agg(*[F.sum(F.when(F.col("fold") == f, F.col(f"b{i}"))).alias(f"f{f}b{i}") for f in range(FOLDS) for i in range(BANDS)], F.sum(sum(F.col(f"b{i}") for i in range(BANDS))).alias("total"))
    n = graded.count()
    rows = by_word.where(F.col("total") >= n * LEAST_SHARE).drop("total").toPandas()
    sums = rows.drop(columns="word").fillna(0.0).to_numpy().reshape(len(rows), FOLDS, BANDS)
    names = rows["word"].tolist()
    return [dict(zip(names, sums.sum(1) - (sums[:, f] if f < FOLDS else 0), strict=True)) for f in range(FOLDS + 1)]


def acquisition_grades(shares: dict[str, np.ndarray]) -> dict[str, float]:
    """Each word's grade: the mean band of its use, each band's text counted alike."""
    if not shares:
        return {}
    names, table = list(shares), np.array(list(shares.values()))
    per_band = table / np.maximum(table.sum(0), 1e-9)
    used = per_band.sum(1)
    grade = (per_band * np.arange(1, BANDS + 1)).sum(1) / np.maximum(used, 1e-12)
    return {w: float(g) for w, g, u in zip(names, grade, used, strict=True) if u > 1e-12}


def _features(graded: DataFrame, by_fold: list[dict[str, float]]) -> DataFrame:
    """Rows (id, bands, x): quantiles from word grades that the document itself had no part in."""
    shared = graded.sparkSession.sparkContext.broadcast(by_fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [quantiles(t.split(), shared.value[f]) for f, t in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([None if x is None else x.tolist() for x in out], pa.list_(pa.float64())), b.column(3)], names=["id", "fold", "bands", "x", "words"])

    return graded.select("id", "fold", "bands", "words").mapInArrow(run, f"id {dict(graded.dtypes)['id']}, fold int, bands array<int>, x array<double>, words string")


def _fit(features: DataFrame) -> Calibration:
    rows = features.where("x is not null").orderBy(F.xxhash64("id"), "id").select("bands", "x").limit(FIT_DOCS).toPandas()
    x = np.array(rows["x"].tolist()) if len(rows) else np.zeros((0, len(QUANTILES) + 1))
    return Calibration.fit(x, np.array([np.median(b) for b in rows["bands"]]), np.array([float(len(b)) for b in rows["bands"]]))


def reading_bands(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, reading_band) of every document with at least MIN_WORDS words of English prose.

    From all rated documents' prose come the words' shares of each band's text, and from these the
    grades at which words are acquired. The quantiles of a document's word grades, calibrated on the
    ratings, give its band. For the calibration a document is described by grades from the folds it
    is not in. Ratings far from what the words say then give way, and grades and calibration are
    made anew. At last all documents are read once, whole, whatever their language tag says.

    Defined cases: null, empty and blank texts, and texts without enough English prose are not
    graded; null ratings are none, of a rater's repeated ratings the last counts; without any
    ratings no text is graded; further columns are ignored. The gathered tables are bounded: at most
    1 / LEAST_SHARE words, FIT_DOCS rows.
    """
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    rated = texts.join(ratings(labels, id_col).withColumnRenamed(id_col, "id"), "id").select("id", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"), "bands", "text")
    id_type = dict(texts.dtypes)["id"]

    def to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([" ".join(english(prose(t))) for t in b.column(3).to_pylist()], pa.string())], names=["id", "fold", "bands", "words"])

    graded = cut(rated.mapInArrow(to_words, f"id {id_type}, fold int, bands array<int>, words string"))
    first = _features(graded, [acquisition_grades(s) for s in word_shares(graded)[:FOLDS]])
    first = cut(first)
    model = _fit(first)
    x = [F.get("x", F.lit(n)) for n in range(len(QUANTILES) + 1)]
    level = sum((F.lit(float(w)) * v for w, v in zip(model.weights[1:], x, strict=True)), F.lit(float(model.weights[0])))
    near = F.filter("bands", lambda b: F.abs(b - F.col("level")) < FAR)
    nearest = F.array(F.greatest(F.lit(1), F.least(F.lit(BANDS), F.round("level"))).cast("int"))
    settled = cut(first.withColumn("level", level).select("id", "fold", F.when(F.col("level").isNull(), F.col("bands")).when(F.size(near) > 0, near).otherwise(nearest).alias("bands"), "words"))
    shares = word_shares(settled)
    model = _fit(_features(settled, [acquisition_grades(s) for s in shares[:FOLDS]]))
    shared = documents.sparkSession.sparkContext.broadcast((acquisition_grades(shares[FOLDS]), model.weights, model.cuts))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, cuts = shared.value
        own = Calibration(weights, cuts)
        for b in batches:
            ids, bands = [], []
            for n, text in enumerate(b.column(1).to_pylist()):
                words = english(prose(text), known)
                if len(words) >= MIN_WORDS and (q := quantiles(words, known)) is not None:
                    ids.append(n)
                    bands.append(own.band(q))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(bands, pa.int32())], names=["id", "reading_band"])

    return texts.mapInArrow(grade, f"id {id_type}, reading_band int").withColumnRenamed("id", id_col)
