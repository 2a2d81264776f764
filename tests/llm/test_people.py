import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import matching as M
from tallywright.llm import names as N
from tallywright.llm import persons as P

COLUMNS = "k string, f string, m string, l string, d string, e string, p string, source string, name string"
FIRST = ["Gabriella", "Elizabeth", "Samuel", "Omar", "Wei", "Chidi", "Freya", "Nicholas", "Priya", "Zachary"]
LAST = ["Faircombe", "Thigisa", "Kholeski", "Marwood", "Penhallow", "Zutubo", "Oakwell", "Lindqvist", "Carradine", "Overstead", "Hazelby", "Quendale"]


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], COLUMNS)


def records(spark, data, source=0):
    return P.people(frame(spark, data), source, F.col("k"), "f", "m", "l", "d", "e", "p")


@pytest.mark.parametrize(
    ("raw", "parts"),
    [("Prof. Mairead", ("mairead",)), ("O'Rothbury", ("rothbury",)), ("O Rothbury", ("rothbury",)), ("O’Rothbury", ("rothbury",)), ("McBlackstone", ("blackstone",)), ("Mc Blackstone", ("blackstone",)), ("R0uve", ("rouve",)), ("Łukasz", ("lukasz",)), ("Zoë", ("zoe",)), ("al-Veikho", ("veikho",)), ("Chosuidis (Intl)", ("chosuidis",)), ("Drayworth, Francesca", ("drayworth", "francesca")), ("", ()), ("  ", ()), ("!!!", ()), ("Mac", ("mac",)), ("K.", ("k",))],
)
def test_clean(raw, parts):
    assert P.clean(raw) == parts


@pytest.mark.parametrize(("text", "number"), [("2004-09-15", 20040915), ("15/09/2004", 20040915), ("15-SEP-2004", 20040915), ("25-JUL-02", 20020725), ("12-28-2006", 20061228), ("20020327", 20020327), ("1995.11.13", 19951113), ("1997-01-19 00:00", 19970119), ("2000-02-30", 0), ("unknown", 0), ("1900-01-01", 0), ("", 0)])
def test_birth_date(text, number):
    assert P.birth_date(text) == number


def test_likeness():
    assert P.part_alike("gabby", "gabriella") == 0.95 and P.part_alike("g", "gabriella") == 0.8 and P.part_alike("g", "omar") == 0.0
    assert abs(P.alike("smith", "smtih") - 0.8) < 1e-9 and P.alike("ca", "abc") == 0.0 and abs(P.alike("kholeski", "khlsekii") - (1 - 4 / 8)) < 0.26
    assert P.monge_elkan(("wei", "marwood"), ("marwood", "wei", "x")) == 1.0 and P.monge_elkan((), ("a",)) == 0.0


@pytest.mark.parametrize(
    ("a", "b", "contradict"),
    [
        ("alexandra||kholeski", "kholeski||katarzyna", True), ("alexandra||kholeski", "katarzyna||kholeski", True), ("alexandra||kholeski", "kholeski||alexandra", False), ("daniel||pajiazoova", "daniel||rothbury", False),
        ("emmanuel|josephine|kholeski", "josephine||kholeski", False), ("k||kholeski", "kofi||kholeski", False), ("gabby||kholeski", "gabriella||kholeski", False), ("||kholeski francesca", "francesca||kholeski", False), ("||", "a||b", False),
    ],
)
def test_contradicting_first_names(a, b, contradict):
    batch = P.Batch([a, b], *np.zeros((3, 2), "i8"), P.Evidence(2))
    assert batch.name_bits(0, 1)[2] is contradict and batch.name_bits(1, 0)[2] is contradict


def test_collision_curve():
    assert N.bands(0.5, 0.9, 2) == 9 and 1 - (1 - 0.42**2) ** N.BANDS[0] >= 0.95
    rng = random.Random(3)
    names = ["|".join([rng.choice(FIRST).lower(), "", rng.choice(LAST).lower()]) for _ in range(60)]
    b = P.Batch(names, *np.zeros((3, 60), "i8"), P.Evidence(60))
    s = b.signature(400)
    code, size = b.grams()
    sets = [set(x.tolist()) for x in np.split(code, np.cumsum(size)[:-1])]
    for i, j in ((0, 1), (2, 3), (4, 5)):
        assert abs((s[i] == s[j]).mean() - len(sets[b.code[i]] & sets[b.code[j]]) / len(sets[b.code[i]] | sets[b.code[j]])) < 0.12
    empty = P.Batch(["||", "a||b", "||"], *np.zeros((3, 3), "i8"), P.Evidence(3)).signature(4)
    assert (empty[0] != empty[2]).all()


def variant(rng, f, l):
    kind = rng.randrange(5)
    if kind == 0:
        return f, l.upper()
    if kind == 1:
        i = rng.randrange(1, len(l) - 1)
        return f, l[:i] + l[i + 1] + l[i] + l[i + 2 :]
    if kind == 2:
        return l, f
    if kind == 3:
        return f[0] + ".", l
    return "Dr " + f, l


def people_data(rng, n):
    """(truth, row): persons with two or three entries each, in part with relatives born the same day."""
    out = []
    for p in range(n):
        f, l = rng.choice(FIRST), LAST[p % len(LAST)] + chr(97 + p // len(LAST)) + "ton"
        d = f"{1980 + rng.randrange(25)}-{1 + rng.randrange(12):02d}-{1 + rng.randrange(28):02d}"
        e, post = f"{f}{p}@x.example", f"AB{p} 1CD"
        for c in range(rng.choice([1, 2, 3])):
            vf, vl = variant(rng, f, l) if c else (f, l)
            out.append((p, (f"{p}-{c}", vf, None, vl, d, e if rng.random() < 0.6 else None, post)))
        if rng.random() < 0.2:
            other = rng.choice([x for x in FIRST if x[0] != f[0]])
            out.append((-p - 1, (f"{p}-twin", other, None, l, d, f"{other}{p}@y.example", post)))
    return out


def test_variants_are_found_and_twins_kept_apart(spark):
    data = people_data(random.Random(4), 150)
    truth = {r[0]: p for p, r in data}
    got = {(r["key_1"], r["key_2"]) for r in N.variants(records(spark, [r for _, r in data])).collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.98


def test_numbered_records_give_the_same(spark):
    data = [r for _, r in people_data(random.Random(19), 100)] + [(None, "Wei", None, "Marwood", "2001-01-02", None, None)]
    numbered = P.people(frame(spark, data), 0, F.col("k"), "f", "m", "l", "d", "e", "p", numbered=True)
    keys = frame(spark, data).select(F.lit(0).alias("source"), F.col("k").alias("key"))
    got = sorted(map(tuple, N.variants(numbered, keys=keys).collect()))
    assert got and got == sorted(map(tuple, N.variants(records(spark, data)).collect()))


def test_links_miss_little_of_all_pairs(spark):
    data = people_data(random.Random(5), 120)
    recs = records(spark, [r for _, r in data]).withColumn("person", F.xxhash64("source", "key"))
    rows = recs.collect()
    known = P.evidence(recs)
    b = P.Batch([r["name"] for r in rows], *(np.array([r[c] or 0 for r in rows]) for c in ("born", "email", "post")), known)
    i, j = np.triu_indices(len(rows), 1)
    i, j = i.astype("i8"), j.astype("i8")
    weights = P.weigh(b, i, j)
    total, like = weights.total, weights.like
    mail = (b.email[i] == b.email[j]) & (b.email[i] != 0)
    ok = (total >= np.log2(known.n) + N.MARGIN) & (mail | (like >= N.MIN_LIKE))
    want = {tuple(sorted((rows[x]["person"], rows[y]["person"]))) for x, y in zip(i[ok], j[ok], strict=True) if rows[x]["person"] != rows[y]["person"]}
    got = {(r["a"], r["b"]) for r in N.link(recs).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_rare_names_are_linked_without_a_shared_block(spark):
    data = [r for _, r in people_data(random.Random(18), 150)]
    rare = [("r1", "Xanthippe", "Quillon", "Featherstonehaugh", "1999-04-05", None, None), ("r2", "Xanthippe", "Quillon", "Featherstonehaugh", "1999-04-06", "x@x.example", None), ("r3", "Xanthippe", "Quillon", "Featherstonehaugh", None, "y@x.example", "QQ1 1QQ")]
    common = [(f"c{n}", "Wei", None, "Marwood", f"19{70 + n}-01-{n + 1:02d}", None, None) for n in range(20)]
    got = {(r["key_1"], r["key_2"]) for r in N.variants(records(spark, data + rare + common)).collect()}
    assert {("r1", "r2"), ("r1", "r3"), ("r2", "r3")} <= got and not [p for p in got if p[0][0] == "c" or p[1][0] == "c"]


def test_hot_values_are_divided(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 20)
    data = [(p, (r[0], r[1], r[2], r[3], "2001-02-03" if p % 3 == 0 else r[4], r[5], r[6])) for p, r in people_data(random.Random(6), 150)]
    truth = {r[0]: p for p, r in data}
    got = {(r["key_1"], r["key_2"]) for r in N.variants(records(spark, [r for _, r in data])).collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert len(got & want) / len(want) > 0.85 and len(got & want) / len(got) > 0.97


def test_stars(spark):
    edges = [(1, 2), (1, 3), (1, 4), (4, 5), (6, 7)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, bits double")
    assert sorted((r["key"], r["center"]) for r in N.star_clusters(df).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 7), (7, 7)]
    assert N.star_clusters(df.limit(0)).count() == 0


def test_edges_of_input(spark):
    assert N.variants(records(spark, [])).count() == 0
    odd = [("a", None, None, None, None, None, None), ("b", "", "", "", "", "", ""), (None, "Wei", None, "Marwood", "2001-01-02", None, None), ("c", "x" * 50_000, None, "y", "2001-01-02", None, None), ("c", "x" * 50_000, None, "y", "2001-01-02", None, None), ("d", "Wei", None, "Marwood", None, None, None), ("e", "Wei", None, "Marwood", None, None, None)]
    assert N.variants(records(spark, odd)).count() == 0
    assert M.match(records(spark, odd).unionByName(records(spark, odd, 1))).where("a != b").count() == 0
    assert M.match(records(spark, [])).count() == 0


def split(data):
    left = [r for p, r in data if r[0].endswith("-0") or r[0].endswith("twin")]
    return left, [r for p, r in data if r[0].endswith("-1")]


def test_matches_across_sources(spark):
    data = people_data(random.Random(7), 150)
    left, right = split(data)
    truth = {r[0]: p for p, r in data}
    got = {(r["a"], r["b"]): r["confidence"] for r in M.match(records(spark, left).unionByName(records(spark, right, 1))).collect()}
    want = {(a[0], b[0]) for a in left for b in right if truth[a[0]] == truth[b[0]]}
    assert len(got.keys() & want) / len(want) > 0.95 and len(got.keys() & want) / len(got) > 0.98
    assert all(0.5 < c <= 1 for c in got.values())


def test_windows_miss_little_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 50)
    data = people_data(random.Random(8), 120)
    left, right = split(data)
    recs = records(spark, left).unionByName(records(spark, right, 1))
    got = {(r["a"], r["b"]): r["bits"] for r in M.candidates(recs).collect()}
    rows = recs.collect()
    known = P.evidence(recs)
    b = P.Batch([r["name"] for r in rows], *(np.array([r[c] or 0 for r in rows]) for c in ("born", "email", "post")), known)
    src = np.array([r["source"] for r in rows])
    i, j = (x.astype("i8") for x in np.nonzero((src[:, None] == 0) & (src[None, :] == 1)))
    total = P.weigh(b, i, j, -1.0, -1.0).total
    n = max(len({r["key"] for r in rows if r["source"] == s}) for s in (0, 1))
    want = {(rows[x]["key"], rows[y]["key"]) for x, y in zip(i[total >= np.log2(n) + M.MARGIN], j[total >= np.log2(n) + M.MARGIN], strict=True)}
    assert set(got) <= want and len(got) >= 0.95 * len(want)


def test_assignment_is_the_best(spark):
    rng = random.Random(9)
    for _ in range(3):
        pairs = [(f"a{i}", f"b{j}", float(rng.randrange(5, 20))) for i in range(6) for j in range(5) if rng.random() < 0.5]
        got = M.assign(spark.createDataFrame(pairs, "a string, b string, bits double"), 1000.0).collect()
        assert len({r["a"] for r in got}) == len(got) == len({r["b"] for r in got})
        value = {(a, b): v for a, b, v in pairs}

        def best(left, used):
            if not left:
                return 0.0
            a, *rest = left
            return max([best(rest, used), *(v + best(rest, used | {b}) for (x, b), v in value.items() if x == a and b not in used)])

        assert sum(r["bits"] for r in got) >= best(sorted({a for a, _, _ in pairs}), frozenset()) - 6 * M.STEP
    sure = [("a1", "b", 50.0), ("a2", "b", 45.0), ("a3", "b", 20.0), ("a3", "c", 10.0)]
    got = {(r["a"], r["b"]) for r in M.assign(spark.createDataFrame(sure, "a string, b string, bits double"), 40.0).collect()}
    assert got == {("a1", "b"), ("a2", "b"), ("a3", "c")}


def test_after_other_operators_of_the_session(spark):
    from tallywright.functions.values import same_composed

    assert spark.createDataFrame([("é", "é")], "a string, b string").select(same_composed("a", "b")).first()[0]
    assert records(spark, [("a", "Wei", None, "Marwood", "05-MAR-2001", None, None)]).first()["born"] == 20010305


def test_all_entries_of_a_person_get_its_partner(spark):
    pairs = spark.createDataFrame([("a1", "b", 50.0), ("a3", "b", 20.0), ("a3", "c", 10.0), ("a4", "d", 22.0), ("a5", "d", 21.0), ("a6", "d", 20.0), ("a6", "e", 19.0)], "a string, b string, bits double")
    one = spark.createDataFrame([("a3", "a1"), ("a5", "a4")], "a string, holder string")
    assert {tuple(r) for r in M.assign(pairs, 40.0, one).select("a", "b", "bits").collect()} == {("a1", "b", 50.0), ("a3", "b", 20.0), ("a4", "d", 22.0), ("a5", "d", 21.0), ("a6", "e", 19.0)}


def test_doubtful_entries_are_matched_and_twins_are_not(spark):
    data = [r for _, r in people_data(random.Random(14), 150)]
    # of this person one entry is sure, one has moved and has no e-mail; the twin has their home and birthday
    mine = [("z1", "Gabriella", None, "Zutubington", "1999-04-05", "g@z.example", "ZZ1 1ZZ"), ("z2", "Gabriella", None, "Zutubington", "1999-04-05", None, "QQ9 9QQ"), ("z3", "Omar", None, "Zutubington", "1999-04-05", None, "ZZ1 1ZZ")]
    theirs = [("s1", "Gabriella", None, "Zutubington", "1999-04-05", "g@z.example", "ZZ1 1ZZ")]
    got = {(r["a"], r["b"]) for r in M.match(records(spark, data + mine).unionByName(records(spark, theirs, 1))).collect()}
    assert {p for p in got if p[1] == "s1"} == {("z1", "s1"), ("z2", "s1")}


def test_rare_values_have_their_own_weight(spark, monkeypatch):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("aeiou" if k % 2 else "bcdfghklmnprst") for k in range(7))
    data = []
    for p in range(7000):  # surnames, addresses that two or three records have
        l, d = word(), f"{1950 + rng.randrange(50)}-{1 + rng.randrange(12):02d}-{1 + rng.randrange(28):02d}"
        data += [(f"{p}-{c}", rng.choice(FIRST), None, l, d, f"{p}@x.example" if p % 3 else None, f"AB{p % 3000}") for c in range(2)]
    recs = P.people(frame(spark, data), 0, F.col("k"), "f", "m", "l", "d", "e", "p").withColumn("person", F.xxhash64("source", "key"))
    two = records(spark, [r for r in data if r[0].endswith("-0")]).unionByName(records(spark, [r for r in data if r[0].endswith("-1")], 1))
    bits = lambda df: {(r["a"], r["b"]): round(r["bits"], 6) for r in df.collect()}
    links, pairs = bits(N.link(recs)), bits(M.candidates(two))
    # with a table of only values that more than three records have, the others are looked up
    monkeypatch.setattr(P, "RARE", 1 / 4096)
    assert P.evidence(recs).least > 3 and links and pairs
    assert bits(N.link(recs)) == links and bits(M.candidates(two)) == pairs
    many = P.Batch(["a||b"] * 2, *np.array([[20010203] * 2, [7] * 2, [8] * 2]), P.Evidence(10**7, email={7: np.log2(10**7 / 2)}))
    assert many.contact("email", np.array([0]), np.array([1]), -1.0)[0] > 22 and many.contact("post", np.array([0]), np.array([1]), -1.0)[0] > 23


def test_dividing_hot_addresses_loses_no_pair(spark, monkeypatch):
    rng = random.Random(17)
    data = []
    for p in range(120):
        l = rng.choice(LAST) + chr(97 + p % 26) + chr(97 + p // 26) + "x"
        data += [(f"{p}-0", "Robert", None, l, None, "hall@x.example", None), (f"{p}-1", "Bob", None, l, f"{1980 + p % 20}-01-{1 + p % 28:02d}", "hall@x.example", None)]
    data += [r for _, r in people_data(rng, 300)]  # so that the mailbox isn't everyone's
    recs = records(spark, data).withColumn("person", F.xxhash64("source", "key"))
    links = lambda: {(r["a"], r["b"]) for r in N.link(recs, 0.0).collect()}
    monkeypatch.setattr(N, "HOT_ADDRESS", 10_000)
    whole = links()
    monkeypatch.setattr(N, "HOT_ADDRESS", 50)
    assert len(whole) > 100 and links() == whole


@pytest.mark.parametrize(("sure", "kept"), [(400_000, [24.6, 25.0, 27.1]), (10, [27.1])])
def test_enough_bits_are_enough_in_a_large_table(spark, sure, kept):
    sizes = {0: 1 << 22, 1: 5}
    assert N.looked_at(1 << 22) < 3 and N.looked_at(1000) == N.MARGIN
    links = spark.createDataFrame([(0, bits) for bits in (24.0, 24.6, 25.0, 27.1)] + [(1, 26.0)], "source int, bits double").unionByName(spark.range(sure).selectExpr("0 as source", "50d as bits"))
    assert sorted(tuple(r) for r in N.likely(links, sizes).where("bits < 50").collect()) == [*((0, bits) for bits in kept), (1, 26.0)]
    assert N.likely(links.limit(0), {}).count() == 0


def test_a_lower_margin_adds_links_and_keeps_their_source(spark):
    data = [(f"{p}-{c}", f, None, LAST[p % 12], f"19{50 + p % 40}-0{1 + p % 9}-1{p % 10}", None, None) for p in range(60) for c, f in enumerate([FIRST[p % 10], FIRST[p % 10][0]])]
    recs = records(spark, data).unionByName(records(spark, data, 1)).withColumn("person", F.xxhash64("source", "key"))
    few, many = ({(r["source"], r["a"], r["b"]) for r in N.link(recs, m).collect()} for m in (N.MARGIN, N.LEAST_MARGIN))
    assert few < many and {s for s, _, _ in many} == {0, 1}
