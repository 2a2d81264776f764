"""Pair scoring of person records by given policies, classification, greedy one-to-one reconciliation, and its report."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.session import cut, small

#: The fuzzy policy's terms (exact, within one edit) in the order they are added, and thresholds.
LAST, FIRST, BORN, EMAIL, ALTERNATE = (0.35, 0.25), (0.20, 0.12), 0.30, 0.15, 0.20
FUZZY_THRESHOLD, REVIEW_BELOW, SURE_ABOVE = 0.7, 0.15, 0.1
#: Reasons that make a match strong whatever its score.
STRONG = ("husid", "ucasPid", "altid")
#: Letters from which a text is long.
LONG = 60
#: Pairs of one birth date or mailbox from which its rows meet by keys of the last name.
MANY = 100_000


def norm(c: Column) -> Column:
    """Trimmed and in lower case; empty is null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def near(a: Column, b: Column) -> Column:
    """Whether two texts are at most one edit apart, an exchange of neighbours being one: no function from outside is needed for one edit."""
    plain = F.levenshtein(a, b, 2)  # -1 beyond
    i = F.lit(1)
    # the first place where they differ; after an exchange there they must be equal
    same = F.length(a) == F.length(b)
    at = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), i)), F.lit(0), lambda acc, n: F.when((acc == 0) & (F.substr(a, n, i) != F.substr(b, n, i)), n).otherwise(acc))
    swapped = F.concat(F.substr(b, i, F.greatest(at - 1, F.lit(0))), F.substr(b, at + 1, i), F.substr(b, at, i), F.substr(b, at + 2, F.length(b)))
    # one edit leaves the first or the last letter, but for very short texts: most pairs need no more than that look
    end = lambda c, n: F.substr(c, F.lit(n), i)
    may = (F.abs(F.length(a) - F.length(b)) <= 1) & ((end(a, 1) == end(b, 1)) | (end(a, -1) == end(b, -1)) | (F.length(a) <= 3))
    return may & (plain.between(0, 1) | (same & (plain == 2) & (at > 0) & (a == swapped)))


def osa(a: str, b: str, limit: int) -> int:
    """Edits between two texts, an exchange of neighbours that aren't edited again being one; limit + 1 where there are more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        if min(new) > limit:
            return limit + 1
        older, old = old, new
    return min(old[-1], limit + 1)


def edits(a: Column, b: Column, limit: int) -> Column:
    """osa() of two columns without regard to case, in Arrow batches; null where either is."""

    @F.pandas_udf("int")
    def count(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa(p, q, limit) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return count(F.lower(a), F.lower(b))


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer, 1 for two empty texts; null where either is. All edits are counted, up to 10,000."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - edits(a, b, 10_000) / longest)


def within(a: Column, b: Column, limit: int) -> Column:
    """Whether two texts are at most so many edits apart. One edit needs no function from outside."""
    return a == b if limit == 0 else near(a, b) if limit == 1 else edits(a, b, limit) <= limit


def near_keys(c: Column, limit: int = 1) -> Column:
    """Keys of which two texts that are at most limit edits apart share at least one: the text, and what is left without up to limit of its letters.

    Of long texts 2 * limit + 1 pieces, of which an edit touches two at most, each from all places to
    which limit edits can move it. Texts of LONG letters, give or take the limit, have both kinds.
    """
    n, i = F.length(c), F.lit(1)
    without = lambda t: F.transform(F.sequence(i, F.greatest(F.length(t), i)), lambda k: F.concat(F.substr(t, i, k - 1), F.substr(t, k + 1, F.length(t))))
    left = F.array(c)
    for _ in range(limit):
        left = F.array_distinct(F.concat(left, F.flatten(F.transform(left, without))))
    short = F.when(n <= LONG + limit, left).otherwise(F.array().cast("array<string>"))
    count = 2 * limit + 1
    step = LONG // (2 * count)
    ends = [F.concat(F.lit(f"{k}^"), F.substr(c, F.lit(1 + limit + k * step + move), F.lit(step))) for k in range(count) for move in range(-limit, limit + 1)]
    pieces = F.when(n >= LONG, F.array(*ends)).otherwise(F.array().cast("array<string>"))
    return F.when(c.isNotNull(), F.array_distinct(F.transform(F.concat(short, pieces), lambda k: F.xxhash64(k))))


def alternate_keys(ids: Column) -> Column:
    """Keys of alternate ids (system, type, value): the value without regard to case."""
    return F.transform(F.coalesce(ids, F.array().cast(ALTERNATES)), lambda x: F.concat_ws("|", x["system"], x["type"], F.lower(x["value"])))


ALTERNATES = "array<struct<system:string,type:string,value:string>>"


def _values(d: DataFrame, key: str, side: str, ids: list[str], alternate: str | None) -> DataFrame:
    """Rows (side_id, reason, value): each id a record has, its alternate ids under the reason altid."""
    each = [F.struct(F.lit(i).alias("reason"), norm(F.col(i).cast("string")).alias("value")) for i in ids]
    own = F.array(*each)
    if alternate:
        own = F.concat(own, F.transform(alternate_keys(F.col(alternate)), lambda v: F.struct(F.lit("altid").alias("reason"), v.alias("value"))))
    return d.select(F.col(key).alias(f"{side}_id"), F.explode(own).alias("_x")).select(f"{side}_id", "_x.reason", "_x.value").where("value is not null").distinct()


def match_exact(a: DataFrame, b: DataFrame, ids: list[str], a_key: str, b_key: str, alternate: str | None = None) -> DataFrame:
    """Pairs that share any of the ids or an alternate id (an array of system, type, value): one equi-join over all ids, so arrays that overlap meet without all pairs being compared.

    As many pairs come out as records share a value; where many do, exact_classes() says the same in
    one row a record. Adaptive execution splits the partitions of hot values.
    """
    left, right = _values(a, a_key, "a", ids, alternate), _values(b, b_key, "b", ids, alternate)
    met = left.join(right, ["reason", "value"])
    return met.groupBy("a_id", "b_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("reason"))).alias("reasons"), F.lit(1.0).alias("score"))


def exact_classes(a: DataFrame, b: DataFrame, ids: list[str], a_key: str, b_key: str, alternate: str | None = None) -> DataFrame:
    """Rows (side, id, reason, value, links): the classes of records that share an id, each with how many records of the other side it has there.

    The pairs of match_exact, not expanded: every record is linked to all of the other side with its
    reason and value. Records without a partner are left out. Values are counted on the map side, and
    what is joined to the records is one row a value, so a value that a third of all rows share costs
    no more than others.
    """
    both = [d.select(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id"), "reason", "value") for s, d in (("a", _values(a, a_key, "a", ids, alternate)), ("b", _values(b, b_key, "b", ids, alternate)))]
    rows = both[0].unionByName(both[1])
    counts = rows.groupBy("reason", "value").agg(F.count_if(F.col("side") == "a").alias("in_a"), F.count_if(F.col("side") == "b").alias("in_b")).where("in_a > 0 and in_b > 0")
    return rows.join(counts, ["reason", "value"]).select("side", "id", "reason", "value", F.when(F.col("side") == "a", F.col("in_b")).otherwise(F.col("in_a")).alias("links"))


def classify(score: Column, reasons: Column, mode: str, threshold: float) -> Column:
    """confident, review or rejected. At the threshold or above, exact and institutional matches, strong reasons and scores SURE_ABOVE it are confident, others for review, as are scores not more than REVIEW_BELOW under it.

    reasons is an array of names of what agreed. Sums of the limits are those of doubles.
    """
    sure = F.lit(mode in ("exact", "institutional")) | F.arrays_overlap(reasons, F.array(*[F.lit(s) for s in STRONG])) | (score >= threshold + SURE_ABOVE)
    return F.when((score >= threshold) & sure, F.lit("confident")).when(score >= threshold - REVIEW_BELOW, F.lit("review")).otherwise(F.lit("rejected"))


def match_institutional(a: DataFrame, b: DataFrame, fields: list[str], a_key: str, b_key: str, block: list[str]) -> DataFrame:
    """Pairs that share the blocking fields, with the share of listed fields that are equal."""
    left = a.select(F.col(a_key).alias("a_id"), *[norm(F.col(f).cast("string")).alias(f"a_{f}") for f in fields])
    right = b.select(F.col(b_key).alias("b_id"), *[norm(F.col(f).cast("string")).alias(f"b_{f}") for f in fields])
    on = reduce(lambda x, y: x & y, [F.col(f"a_{f}") == F.col(f"b_{f}") for f in block])
    equal = [F.when(F.col(f"a_{f}") == F.col(f"b_{f}"), F.lit(1)).otherwise(F.lit(0)) for f in fields]
    return left.join(right, on).select("a_id", "b_id", F.round(sum(equal[1:], equal[0]) / len(fields), 6).alias("score"))


def match_fuzzy(a: DataFrame, b: DataFrame, a_key: str, b_key: str, last: str, first: str, born: str, email: str, threshold: float = FUZZY_THRESHOLD, limit: int = 1, alternate: str | None = None) -> DataFrame:
    """Pairs with the fuzzy policy's score, classified confident, review or rejected; the rejected are dropped.

    limit is the number of edits up to which names count as near; alternate names an array of
    alternate ids (system, type, value), which add once. A pair that is kept shares an alternate id,
    or has both names equal, or near last names and an equal birth date or e-mail address, or birth
    date and address equal: the terms allow no other. So equi-joins find all of them, at the default
    threshold. Near last names share one of their near_keys, which divide the rows of a birth date (a
    placeholder, say) or a mailbox that makes more than MANY pairs; none are left out, and other
    values' rows meet directly.
    """
    if threshold < FUZZY_THRESHOLD:
        raise ValueError("below the default threshold the joins would miss pairs")
    fields = {"last": last, "first": first, "born": born, "email": email}
    keys = lambda d: alternate_keys(F.col(alternate)) if alternate else F.array().cast("array<string>")
    side = lambda d, key, s: d.select(F.col(key).alias(f"{s}_id"), *[norm(F.col(c).cast("string")).alias(f"{s}_{n}") for n, c in fields.items()], keys(d).alias(f"{s}_alt"))
    left, right = cut(side(a, a_key, "a")), cut(side(b, b_key, "b"))  # read by each join
    both = lambda x, y: (F.col(f"a_{x}") == F.col(f"b_{x}")) & (F.col(f"a_{y}") == F.col(f"b_{y}"))
    parts = [left.join(right, both("last", "first")), left.join(right, both("born", "email"))]
    if alternate:
        parts.append(left.withColumn("_k", F.explode("a_alt")).join(right.withColumn("_k", F.explode("b_alt")), "_k").drop("_k"))
    close = within(F.col("a_last"), F.col("b_last"), limit)
    for c in ("born", "email"):
        counts = [d.where(f"{s}_{c} is not null").groupBy(F.col(f"{s}_{c}").alias("_v")).agg(F.count(F.lit(1)).alias(f"_n{s}")) for d, s in ((left, "a"), (right, "b"))]
        hot = small(counts[0].join(counts[1], "_v").where(F.col("_na") * F.col("_nb") > MANY).select("_v"))
        part = lambda d, s, how, c=c, hot=hot: d.join(hot, F.col(f"{s}_{c}") == F.col("_v"), how)
        parts.append(part(left, "a", "left_anti").join(right, (F.col(f"a_{c}") == F.col(f"b_{c}")) & close))
        keyed = lambda d, s, k: d.withColumn(k, F.explode(near_keys(F.col(f"{s}_last"), limit)))
        l, r = keyed(part(left, "a", "left_semi"), "a", "_k"), keyed(part(right, "b", "left_semi"), "b", "_kb")
        parts.append(l.join(r, (F.col(f"a_{c}") == F.col(f"b_{c}")) & (F.col("_k") == F.col("_kb"))).drop("_k", "_kb"))
    pairs = reduce(DataFrame.unionByName, parts).distinct()
    eq = lambda n: F.coalesce(F.col(f"a_{n}") == F.col(f"b_{n}"), F.lit(False))
    term = lambda n, w: F.when(eq(n), F.lit(w[0])).when(F.coalesce(within(F.col(f"a_{n}"), F.col(f"b_{n}"), limit), F.lit(False)), F.lit(w[1])).otherwise(F.lit(0.0))
    shared = F.coalesce(F.arrays_overlap("a_alt", "b_alt"), F.lit(False))
    plus = lambda test, w: F.when(test, F.lit(w)).otherwise(F.lit(0.0))
    score = F.least(F.lit(1.0), term("last", LAST) + term("first", FIRST) + plus(eq("born"), BORN) + plus(eq("email"), EMAIL) + plus(shared, ALTERNATE))
    scored = pairs.select("a_id", "b_id", score.alias("score"), F.when(shared, F.array(F.lit("altid"))).otherwise(F.array().cast("array<string>")).alias("_r"))
    return scored.select("a_id", "b_id", "score", classify(F.col("score"), F.col("_r"), "fuzzy", threshold).alias("kind")).where("kind <> 'rejected'")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Pairs taken greedily by score, then ids, each id once.

    A pair that is first for both its ids would be taken by the greedy scan whatever comes before;
    all such pairs are taken at once, their ids leave, and the rest goes on. Rounds are few, and
    each round's state is written to the checkpoint folder.
    """
    left = cut(pairs.select("a_id", "b_id", "score"))
    taken: list[DataFrame] = []
    while not left.isEmpty():
        order = [F.col("score").desc(), F.col("a_id").asc(), F.col("b_id").asc()]
        ranked = left.withColumns({"_ra": F.row_number().over(Window.partitionBy("a_id").orderBy(*order)), "_rb": F.row_number().over(Window.partitionBy("b_id").orderBy(*order))})
        won = cut(ranked.where("_ra = 1 and _rb = 1").select("a_id", "b_id", "score"))
        taken.append(won)
        left = cut(left.join(won.select("a_id"), "a_id", "left_anti").join(won.select("b_id"), "b_id", "left_anti").select("a_id", "b_id", "score"))
    return reduce(DataFrame.unionByName, taken) if taken else left


def conflicts(matched: DataFrame, a: DataFrame, b: DataFrame, a_key: str, b_key: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rows (a_id, b_id, field, value_a, value_b): fields in which both records of a matched pair have a value, and not the same after norm(). fields: a's and b's column by field."""
    side = lambda d, key, s, at: d.select(F.col(key).alias(f"{s}_id"), *[F.col(c[at]).cast("string").alias(f"{s}_{f}") for f, c in fields.items()])
    both = matched.select("a_id", "b_id").join(side(a, a_key, "a", 0), "a_id").join(side(b, b_key, "b", 1), "b_id")
    differ = [F.when(norm(F.col(f"a_{f}")) != norm(F.col(f"b_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("value_a"), F.col(f"b_{f}").alias("value_b"))) for f in fields]
    return both.select("a_id", "b_id", F.explode(F.array_compact(F.array(*differ))).alias("_c")).select("a_id", "b_id", "_c.*")


def reconciliation_report(matched: DataFrame, a: DataFrame, b: DataFrame, a_key: str, b_key: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row: matched, a_only, b_only, conflicting, total_a, total_b."""
    matched = cut(matched.select("a_id", "b_id"))
    with_conflicts = conflicts(matched, a, b, a_key, b_key, fields).select("a_id", "b_id").distinct()
    counted = lambda kind, d: d.select(F.lit(kind).alias("kind"))
    only = lambda d, key, m: d.join(matched, d[key] == matched[m], "left_anti")
    kinds = {"matched": matched, "a_only": only(a, a_key, "a_id"), "b_only": only(b, b_key, "b_id"), "conflicting": with_conflicts, "total_a": a, "total_b": b}
    return reduce(DataFrame.unionByName, [counted(k, d) for k, d in kinds.items()]).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def merge_log(pairs: DataFrame, decision: Column, by: str, at: Column) -> DataFrame:
    """Rows (entry_id, a_id, b_id, score, kind, decision, decided_by, decided_at): decisions on pairs, for an append-only log; the id is a hash of what was decided and when."""
    entry = F.sha2(F.concat_ws("|", F.col("a_id").cast("string"), F.col("b_id").cast("string"), decision, F.lit(by), at.cast("string")), 256)
    return pairs.select(entry.alias("entry_id"), "a_id", "b_id", "score", "kind", decision.alias("decision"), F.lit(by).alias("decided_by"), at.alias("decided_at"))
