"""Schema mapping: token overlap, hash embeddings, nearest vectors, learned mappings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.session import BROADCAST_ROWS, tasks

DIMENSIONS = 256
#: Scores of an equal and a contained name, the least Jaccard overlap, and the least score of a suggestion.
EQUAL, CONTAINED, MIN_JACCARD, MIN_SCORE = 0.95, 0.8, 0.25, 0.35
#: Rows of the query side compared at once, with so many rows of the index.
BLOCK, CHUNK = 256, 4096


def tokens(c: Column) -> Column:
    """A name's words of two letters or more in lower case, split at case changes and marks, each once."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), " "), lambda t: F.length(t) >= 2))


def squashed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def _meeting(left: DataFrame, right: DataFrame, texts: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (_l, _r) of different names that share a word, or of which one may contain the other.

    A name of three letters or more that another contains shares a three-letter part with it; the few
    shorter ones are found among all parts of their length. texts: further columns of right whose words count.
    """
    squash = lambda c: squashed(F.col(c))
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(squash(c)) - (n - 1))), lambda i: F.substr(squash(c), i, F.lit(n)))
    parts = lambda c, *more: F.array_distinct(F.concat(pieces(c, 3), tokens(F.col(c)), *[tokens(F.col(m)) for m in more]))
    short = lambda d, c: d.where((F.length(squash(c)) > 0) & (F.length(squash(c)) < 3)).withColumn("_p", squash(c))
    small_parts = lambda c: F.array_distinct(F.concat(pieces(c, 1), pieces(c, 2)))
    met = [left.withColumn("_p", F.explode(parts("_l"))).join(right.withColumn("_p", F.explode(parts("_r", *texts))), "_p")]
    met.append(short(left, "_l").join(right.withColumn("_p", F.explode(small_parts("_r"))), "_p"))
    met.append(left.withColumn("_p", F.explode(small_parts("_l"))).join(short(right, "_r"), "_p"))
    pairs = met[0].drop("_p").unionByName(met[1].drop("_p")).unionByName(met[2].drop("_p"))
    return pairs.distinct()


def suggest(columns: DataFrame, column: str, targets: DataFrame, target: str, top: int = 4, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows (column, target, score, rank): the best targets by equal, contained or overlapping names.

    Names are told apart first, so the joins are over different names. A name without letters or
    digits has no suggestion.
    """
    left = columns.select(F.col(column).alias("_l")).where("_l is not null").distinct()
    right = targets.select(F.col(target).alias("_r")).where("_r is not null").distinct()
    met = _meeting(left, right)
    a, b = squashed(F.col("_l")), squashed(F.col("_r"))
    overlap = jaccard(tokens(F.col("_l")), tokens(F.col("_r")))
    score = F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(EQUAL)).when(a.contains(b) | b.contains(a), F.lit(CONTAINED)).when(overlap >= MIN_JACCARD, overlap).otherwise(F.lit(0.0))
    scored = met.select(F.col("_l").alias(column), F.col("_r").alias(target), F.round(score, 6).alias("score")).where(F.col("score") >= min_score)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(column).orderBy(F.desc("score"), F.asc(target))).cast("long"))
    return ranked.where(F.col("rank") <= top)


def flat_index(sections: DataFrame, systems: tuple[str, ...] = ("banner", "sits")) -> DataFrame:
    """Rows (canonical, entity, system, source) of a corpus of sections (entity, fields: array of canonical and a source for each system); fields without a source in a system are left out."""
    fields = sections.select("entity", F.explode("fields").alias("_f"))
    each = F.array(*[F.struct(F.lit(s).alias("system"), F.col(f"_f.{s}").alias("source")) for s in systems])
    return fields.select(F.col("_f.canonical").alias("canonical"), "entity", F.explode(each).alias("_s")).select("canonical", "entity", "_s.system", "_s.source").where("coalesce(source, '') <> ''")


def suggest_mapping(columns: DataFrame, column: str, index: DataFrame, system: str, scope: list[str] | None = None, learned: DataFrame | None = None, top: int = 4, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows (column, canonical, entity, score, rank) from an index of (canonical, entity, system, source): the best and its alternatives; nothing for a column whose best score is below min_score.

    A column that is one of a source's words scores EQUAL, one that contains a source or is contained
    CONTAINED, else the larger share of words common with the source or the canonical name, from
    MIN_JACCARD. What was accepted before (learned: column, canonical, entity, confidence) is a candidate
    with its confidence. Of one canonical field the best score counts; ties go to what was learned, then by entity and canonical name.
    """
    own = index.where(F.col("system") == system)
    if scope is not None:
        own = own.where(F.col("entity").isin(*scope))
    left = columns.select(F.col(column).alias("_l")).where("_l is not null").distinct()
    right = own.select(F.col("source").alias("_r"), "canonical", "entity").where("_r is not null").distinct()
    met = _meeting(left, right, ("canonical",))
    a, b = squashed(F.col("_l")), squashed(F.col("_r"))
    best = F.greatest(jaccard(tokens(F.col("_l")), tokens(F.col("_r"))), jaccard(tokens(F.col("_l")), tokens(F.col("canonical"))))
    score = F.when((a == "") | (b == ""), F.lit(0.0)).when(F.array_contains(tokens(F.col("_r")), a), F.lit(EQUAL)).when(a.contains(b) | b.contains(a), F.lit(CONTAINED)).when(best >= MIN_JACCARD, best).otherwise(F.lit(0.0))
    scored = met.select("_l", "canonical", "entity", F.round(score, 6).alias("score"), F.lit(1).alias("_from"))
    if learned is not None:
        prior = learned if scope is None else learned.where(F.col("entity").isin(*scope))
        scored = scored.unionByName(left.join(prior.select(F.col(column).alias("_l"), "canonical", "entity", F.col("confidence").cast("double").alias("score"), F.lit(0).alias("_from")), "_l"))
    once = scored.where("score > 0").groupBy("_l", "entity", "canonical").agg(F.max(F.struct("score", (-F.col("_from")).alias("_from"))).alias("_s")).select("_l", "entity", "canonical", "_s.score", "_s._from")
    order = Window.partitionBy("_l").orderBy(F.desc("score"), F.desc("_from"), "entity", "canonical")
    ranked = once.withColumns({"rank": F.row_number().over(order).cast("long"), "_top": F.max("score").over(Window.partitionBy("_l"))})
    return ranked.where((F.col("rank") <= top) & (F.col("_top") >= min_score)).select(F.col("_l").alias(column), "canonical", "entity", "score", "rank")


def suggestion_lines(suggestions: DataFrame, columns: DataFrame, column: str) -> DataFrame:
    """Rows (column, line) for a report: each column with its best suggestion and the alternatives, or that there is none."""
    text = F.concat(F.col("entity"), F.lit("."), F.col("canonical"), F.lit(" ("), F.format_number("score", 2), F.lit(")"))
    found = suggestions.groupBy(column).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), ", ").alias("_t"))
    names = columns.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    return names.join(found, column, "left").select(column, F.concat(F.lit("| "), F.col(column), F.lit(" | "), F.coalesce("_t", F.lit("no match")), F.lit(" |")).alias("line"))


def learned_confidence(accepts: Column) -> Column:
    """Confidence in a mapping that was accepted so often."""
    return F.least(F.lit(0.98), F.round(0.85 + (1 - F.exp(-0.4 * accepts)) * 0.13, 2))


def best_learned(events: DataFrame, source: str, target: str, at: str) -> DataFrame:
    """Per source the target accepted most, then last."""
    counts = events.groupBy(source, target).agg(F.count(F.lit(1)).alias("accepts"), F.max(at).alias("last_accepted"))
    best = counts.groupBy(source).agg(F.max_by(F.struct(target, "accepts", "last_accepted"), F.struct("accepts", "last_accepted", target)).alias("_b"))
    return best.select(source, "_b.*").withColumn("confidence", learned_confidence(F.col("accepts")))


def _fnv(text: str) -> int:
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def embed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, embedding): counts of words and their 3- and 4-letter parts hashed into DIMENSIONS, of length 1; zeros for a blank text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for b in batches:
            out = np.zeros((b.num_rows, DIMENSIONS), "f4")
            for n, text in enumerate(b.column(1).to_pylist()):
                for word in (text or "").lower().split():
                    if word not in known:
                        if len(known) > 200_000:
                            known.clear()
                        parts = [word, *(word[i : i + k] for k in (3, 4) for i in range(len(word) - k + 1))]
                        known[word] = np.array([_fnv(p) % DIMENSIONS for p in parts])
                    np.add.at(out[n], known[word], 1)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, norm, out=out, where=norm > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float32()))], names=["id", "embedding"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, embedding array<float>").withColumnRenamed("id", id_col)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, the shorter one's length deciding; 0 with a zero vector."""
    n = F.least(F.size(a), F.size(b))
    double = lambda v: F.transform(F.slice(v, F.lit(1), n), lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def unit(v: Column) -> Column:
    """A vector of length 1; a vector of zeros as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of those of an array of equally long vectors whose mask is 1, of length 1; zeros where the mask has none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda p, q: p + q.cast("double")))
    return unit(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))


def nearest(queries: DataFrame, index: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """Rows (query_id, id, score, rank): for each query the k vectors of greatest cosine, ties by id.

    Queries come in blocks of vectors, the index in chunks; every block meets every chunk, gives its k
    best there by one matrix product, and the chunks' bests are merged. Up to BROADCAST_ROWS queries,
    counted, go to where the chunks are; more of them are repeated for each group of chunks and meet
    these by the group's number. What is shuffled after is queries x k x chunks, not pairs.

    Defined cases: a vector of zeros has a cosine of 0 with all; equal scores go by id; rows repeat as
    often as they come; an empty table on either side gives no rows.
    """
    kind = dict(index.dtypes)[id_col]
    total = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("qv"))
    asked, held = total.count(), index.count()
    blocks = total.groupBy((F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)) % F.lit(max(1, -(-asked // BLOCK)))).alias("block")).agg(F.collect_list(F.struct("query_id", "qv")).alias("qs"))
    chunks = index.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-held // CHUNK)))).alias("chunk")).agg(F.collect_list(F.struct("id", "v")).alias("vs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qs, vs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                unit = lambda rows, c: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30))(np.array([r[c] for r in rows], float))
                scores = unit(qs, "qv") @ unit(vs, "v").T
                ids = np.array([r["id"] for r in vs])
                out: list[tuple] = []
                for r, row in zip(qs, scores, strict=True):
                    best = np.lexsort((ids, -np.round(row, 12)))[:k]
                    out += [(r["query_id"], ids[n].item(), float(row[n])) for n in best]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2])], names=["query_id", "id", "score"])

    if asked <= BROADCAST_ROWS:
        both = chunks.crossJoin(F.broadcast(blocks.select("qs")))
    else:
        groups = tasks(queries.sparkSession, held, CHUNK * 16)
        both = chunks.withColumn("group", F.pmod("chunk", F.lit(groups))).join(blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))), "group")
    met = both.select("qs", "vs").mapInArrow(run, f"query_id {dict(queries.dtypes)[id_col]}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc("id"))
    return met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
