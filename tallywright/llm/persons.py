"""Records of people: names, birth dates and contact data in one notation, and the evidence that two are one person.

Both matching between sources and linking of variant spellings weigh the same evidence, in bits:
log2 of how much likelier an agreement is between two records of one person than between records of
two. How likely it is between two comes from how often the value occurs, so an address that many
share says little, whatever it is, and thresholds rise with the number of records.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.values import MONTHS
from tallywright.session import cut

#: Titles, suffixes and particles that are no part of a name; common English short forms by name.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame rev".split())
SUFFIXES = frozenset("jr snr sr jnr ii iii iv bsc ba ma msc phd mba meng beng esq intl deceased".split())
PARTICLES = frozenset("o al el di de da du la le del van von der den st san santa mac mc ap ab bin ibn".split())
SHORT_FORMS = """
abigail abby gail; aleksandra ola; alexander alex sandy xander; alexandra alex sandra; andrew andy drew; anthony tony; benjamin ben benji;
caroline caro carrie; catherine cathy kate katie; charles charlie chas chuck; charlotte charlie lottie; christina chris tina; christopher chris kit;
daniel dan danny; david dave davy; deborah deb debbie; dorothy dolly dot; edward eddie ned ted; eleanor ella ellie nell nora;
elizabeth beth betty eliza libby liz lizzie; emmanuel manny; florence flo florrie; francesca fran frankie; frederick fred freddie;
gabriella bella ella gabby; geoffrey geoff; giovanni gianni vanni; gregory greg; guillermo memo; henry hal harry; isabella bella izzy;
jacob jake; james jamie jim jimmy; jennifer jen jenny; john jack johnny; jonathan jon jonny; joseph joe joey; josephine jo josie;
katarzyna kasia; katherine kate kathy katie kit; kenneth ken kenny; krzysztof chris krzys; lawrence larry laurie; leonard len lenny leo;
madeleine maddie; margaret maggie meg peggy; matthew matt matty; michael mick mike; muhammad mo mohamed mohammed; natasha nat tasha;
nathaniel nat nathan; nicholas nic nick nicky; nicola nic nicky; oliver ollie; olivia liv livvy; patricia pat patsy trish; patrick paddy pat;
peter pete; philip phil pip; philippa pip pippa; raymond ray; rebecca becca becky; richard dick rich richie rick; robert bob bobby rob robbie;
ronald ron ronnie; samantha sam sammy; samuel sam sammy; sebastian bas seb; stephanie steph; stephen steve stevie; susannah sue sukie susie;
theodore ted teddy theo; thomas tom tommy; timothy tim timmy; victoria tori vicky vix; william bill billy will; yevgenia zhenya; zachary zac zach zak
"""
#: Share of the records from which a value counts as frequent: at most 1 / RARE values are, which bounds the table of them.
RARE = 1 / 20_000
#: Bits of a value that occurs once, at least.
MOST_BITS = -np.log2(RARE)
#: Cells of part likeness that are held at once.
COMPARED = 2_000_000
GRAM_BITS = 256
#: Years that make a generation, and dates that stand for an unknown one.
GENERATION, NO_DATES = 15, (19000101, 11111111, 99991231)

_MARKS = {ord(a): b for a, b in zip("øłđðħıßæœþ", ["o", "l", "d", "d", "h", "i", "ss", "ae", "oe", "th"], strict=True)}
_PREFIX = re.compile(r"\b(?:mc|mac|o')(?=[a-z]{4})")


#: Likeness of words below this is none.
LEAST_ALIKE = 0.4


def _memo(size: int) -> Callable:
    """Remembers results; a plain closure, so that it travels to executors by value."""

    def wrap(f: Callable) -> Callable:
        known: dict = {}

        def call(*a: str):
            x = known.get(a)
            if x is None:
                if len(known) >= size:
                    known.clear()
                x = known[a] = f(*a)
            return x

        call.__doc__ = f.__doc__
        return call

    return wrap


def _short_forms() -> dict[str, frozenset[str]]:
    names: dict[str, set[str]] = {}
    for group in SHORT_FORMS.replace("\n", " ").split(";"):
        name, *short = group.split()
        for s in (name, *short):
            names.setdefault(s, set()).add(name)
    return {s: frozenset(of) for s, of in names.items()}


_FULL = _short_forms()


@_memo(200_000)
def clean(name: str) -> tuple[str, ...]:
    """A name's parts: lower case, without accents, titles, suffixes, particles and marks; look-alike digits as letters."""
    if name.isascii() and name.isalpha():  # most names
        s = name.lower()
        if not s.startswith(("mc", "mac")):
            return () if s in TITLES or s in SUFFIXES else (s,)
    s = unicodedata.normalize("NFKD", name.casefold()).translate(_MARKS)
    s = "".join(c for c in s if not unicodedata.combining(c)).replace("’", "'").replace("`", "'")
    s = s.replace("0", "o").replace("1", "l").replace("5", "s")
    s = _PREFIX.sub("", re.sub(r"\bo (?=[a-z]{4})", "o'", s))
    parts = re.sub(r"[^a-z ]", " ", s.replace("'", "")).split()
    kept = [p for p in parts if p not in TITLES and p not in SUFFIXES]
    return tuple([p for p in kept if p not in PARTICLES] or kept)


@_memo(500_000)
def alike(a: str, b: str) -> float:
    """1 - edits / length, where two neighbouring letters that change places are one edit; 0 below LEAST_ALIKE.

    The letters two words share bound their likeness, so most pairs need no table of edits; common
    beginnings and ends cost no edits and leave a small one.
    """
    if a == b:
        return 1.0
    long = max(len(a), len(b))
    if sum([min(a.count(c), b.count(c)) for c in set(a)]) < LEAST_ALIKE * long:
        return 0.0
    i, n, m = 0, len(a), len(b)
    while i < n and i < m and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[i:n], b[i:m]
    n, m = len(a), len(b)
    older, old = [], list(range(m + 1))
    for i in range(1, n + 1):
        new = [i]
        x = a[i - 1]
        for j in range(1, m + 1):
            y = b[j - 1]
            d = old[j - 1] if x == y else 1 + min(old[j - 1], old[j], new[j - 1])
            if i > 1 and j > 1 and x != y and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        older, old = old, new
    likeness = 1 - old[m] / long
    return likeness if likeness >= LEAST_ALIKE else 0.0


@_memo(500_000)
def part_alike(a: str, b: str) -> float:
    """Likeness of two parts of names: a short form 0.95, an initial 0.8, else by edits."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.8 if a[0] == b[0] else 0.0
    fa, fb = _FULL.get(a), _FULL.get(b)
    if fa and fb and fa & fb:
        return 0.95
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return 0.9
    if min(len(a), len(b)) >= 4 and (a.endswith(b) or b.endswith(a)):
        return 0.85
    x = alike(a, b)
    if x < 0.75 and (fa or fb):  # a short form that was misspelt, or of a misspelt name
        x = max([x, *(alike(p, b) - 0.05 for p in fa or ()), *(alike(a, p) - 0.05 for p in fb or ())])
    return x


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Mean likeness of the shorter name's parts to the nearest parts of the longer."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    return sum(max(part_alike(x, y) for y in b) for x in a) / len(a)


#: From this likeness on parts answer to each other; from the second on without doubt. Parts that are only alike have at most so many
#: bits to give, fewer than any rare part has. Bits of two birth dates that differ in one part of three.
LIKE, CLOSE, MOST_ALIKE, TWO_PARTS = 0.58, 0.78, 12.0, 3.0


_DATES = [re.compile(p) for p in (r"(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})", r"(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4}|\d\d)", r"(\d{1,2})[- ]?([A-Z]{3})[A-Z]*[- ]?(\d{4}|\d\d)")]


@_memo(200_000)
def birth_date(text: str) -> int:
    """yyyymmdd as a number, 0 where no date can be read.

    Reads the year, month and day with any marks between, with or without a time; day, month (number
    or name) and year; and with the month first where day first is no date. Two-digit years are of
    the last hundred. Dates that stand for an unknown one are none.
    """
    s = re.sub(r"[T ]\d\d?:[\d:.]*Z?$", "", text.strip().upper())
    for n, pattern in enumerate(_DATES):
        if (m := pattern.fullmatch(s)) is None:
            continue
        y, mo, d = m.groups() if n == 0 else reversed(m.groups())
        y = int(y) + (0 if len(y) == 4 else 2000 if int(y) <= 25 else 1900)
        mo = MONTHS.index(mo) + 1 if mo in MONTHS else int(mo) if mo.isdigit() else 0
        for month, day in ((mo, int(d)), (int(d), mo)) if n == 1 else ((mo, int(d)),):
            try:
                date(y, month, day)
            except ValueError:
                continue
            number = y * 10000 + month * 100 + day
            return 0 if number in NO_DATES else number
    return 0


def people(df: DataFrame, source: int, key: Column, first: str, middle: str | None, last: str, birth: str, email: str | None, postcode: str | None, numbered: bool = False) -> DataFrame:
    """The distinct records (source, key, name, born, email, post) of a table, one for each spelling and contact.

    With numbered they have person, the number() of source and key, instead of the key, which may be long.

    name is first|middle|last with the parts of each apart by blanks. Records that are equal after
    cleaning are one. email and post are hashes, null where blank. Rows without a key are left out.
    """
    text = lambda c: F.col(c) if c else F.lit(None).cast("string")
    spaced = r"(?U)\s"
    packed = lambda c: F.lower(F.when(text(c).rlike(spaced), F.regexp_replace(text(c), spaced, "")).otherwise(text(c)))
    hashed = lambda c: F.when(F.length(text(c)) > 0, F.nullif(F.xxhash64(packed(c)), F.xxhash64(F.lit(""))))
    own, kind = (number(F.lit(source), key.cast("string")).alias("person"), "person bigint") if numbered else (key.cast("string").alias("key"), "key string")
    raw = df.where(key.isNotNull()).select(own, text(first).alias("f"), text(middle).alias("m"), text(last).alias("l"), F.col(birth).cast("string").alias("born"), hashed(email).alias("email"), hashed(postcode).alias("post"))

    def told(column: pa.Array, read: Callable, kind: pa.DataType) -> pa.Array:
        """read over a column, once for each different text."""
        texts = column.fill_null("").dictionary_encode()
        return pa.array([read(x) for x in texts.dictionary.to_pylist()], kind).take(texts.indices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [told(b.column(n), lambda x: " ".join(clean(x)) if x else "", pa.string()) for n in (1, 2, 3)]
            born = told(b.column(4), lambda x: birth_date(x) or None if x else None, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_join_element_wise(*names, "|"), born, b.column(5), b.column(6)], names=[kind.split()[0], "name", "born", "email", "post"])

    cleaned = raw.mapInArrow(run, kind + ", name string, born int, email bigint, post bigint")
    return cleaned.distinct().select(F.lit(source).alias("source"), kind.split()[0], "name", "born", "email", "post")


def number(source: Column, key: Column) -> Column:
    """A 64-bit hash for each source and key."""
    return F.xxhash64(source, key)


@dataclass
class Evidence:
    """Bits by value; a value without any occurs once. n is the number of records, exact whether all values that occur twice are here."""

    n: int
    parts: dict[str, float] = field(default_factory=dict)
    born: dict[int, float] = field(default_factory=dict)
    email: dict[int, float] = field(default_factory=dict)
    post: dict[int, float] = field(default_factory=dict)

    @property
    def most(self) -> float:
        """Bits of a value that occurs once."""
        return max(MOST_BITS, float(np.log2(max(2, self.n))))

    @property
    def least(self) -> float:
        """Records from which a value counts as frequent."""
        return max(2.0, self.n * RARE)


#: Kinds of values in a tally: a number for each column, and one for parts of names.
KINDS, PART = ("born", "email", "post"), 3


def tally(records: DataFrame) -> DataFrame:
    """Rows (kind, value, word, c): how many records have a value, for all values that two or more have, from all records.

    Counted on the map side first, so a value that many records share makes no hot group.
    """
    none, no_word = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    numbers = [F.struct(F.lit(n).alias("kind"), F.col(c).cast("bigint").alias("value"), no_word.alias("word")) for n, c in enumerate(KINDS)]
    words = F.transform(F.array_distinct(F.filter(F.split(F.translate("name", "|", " "), " "), lambda w: w != "")), lambda w: F.struct(F.lit(PART).alias("kind"), none.alias("value"), w.alias("word")))
    each = F.filter(F.concat(F.array(*numbers), words), lambda x: x["value"].isNotNull() | x["word"].isNotNull())
    return cut(records.select(F.explode(each).alias("_v")).groupBy("_v.kind", "_v.value", "_v.word").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))


def evidence(records: DataFrame, counts: DataFrame | None = None) -> Evidence:
    """The bits of frequent values, and of all birth dates, from a tally of all records.

    Only values with RARE of the records or more are gathered, at most 1 / RARE of each kind (for
    parts of names some times that), and birth dates, of which there are no more than days in the
    calendar. settle() has the exact counts of the others.
    """
    out = Evidence(records.count())
    counts = tally(records) if counts is None else counts
    for r in counts.where((F.col("kind") == 0) | (F.col("c") >= out.least)).collect():
        getattr(out, (*KINDS, "parts")[r["kind"]])[r["word"] if r["kind"] == PART else r["value"]] = float(-np.log2(r["c"] / out.n))
    return out


#: What a comparison gives of a pair: its bits if its rare values occurred once, and those values, as far as both records have them.
PAIR = "bits double, email bigint, post bigint, words array<string>"


def settle(pairs: DataFrame, counts: DataFrame, known: Evidence, threshold: float) -> DataFrame:
    """Rows (a, b, bits), the most of each pair, with the exact counts of all values, as far as they reach the threshold.

    pairs has (a, b) and PAIR; what else it has of a and b goes on. Values that are not frequent count in it as if they occurred once,
    which gives no less than their bits; the pairs that reach the threshold so are few, and only
    their values are looked up in the tally.
    """
    value = lambda kind, v, w: F.xxhash64(kind, v, w)
    pair = ["a", "b", *(c for c in pairs.columns if c not in ("a", "b", *PAIR_NAMES))]
    none, no_word = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    own = F.concat(
        F.filter(F.array(*[F.when(F.col(c).isNotNull(), value(F.lit(n), F.col(c), no_word)) for n, c in enumerate(KINDS) if n]), lambda x: x.isNotNull()),
        F.transform("words", lambda w: value(F.lit(PART), none, w)),
    )
    pairs = pairs.where(F.col("bits") >= threshold)
    if known.least > 2:
        counts = counts.where((F.col("kind") > 0) & (F.col("c") < known.least)).select(value(F.col("kind"), F.col("value"), F.col("word")).alias("v"), (F.lit(known.most) - F.log2(F.lit(float(known.n)) / F.col("c"))).alias("less"))
        # of pairs with the same values the one with most bits has most bits in the end
        pairs = pairs.groupBy(*pair, F.sort_array(own).alias("rare")).agg(F.max("bits").alias("bits"))
        each = pairs.select(*pair, "rare", "bits", F.explode_outer("rare").alias("v")).join(counts, "v", "left")
        each = each.repartition("a", "b").groupBy(*pair, "rare").agg(F.first("bits").alias("bits"), F.sum(F.col("less").cast("decimal(18,9)")).cast("double").alias("less"))
        pairs = each.select(*pair, (F.col("bits") - F.coalesce("less", F.lit(0.0))).alias("bits")).where(F.col("bits") >= threshold)
    return pairs.groupBy(*pair).agg(F.max("bits").alias("bits"))


def numbers(t: pa.Table, name: str) -> np.ndarray:
    """A column as an array, nulls as 0."""
    return t[name].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)


class Batch:
    """Some records as arrays, and the evidence between pairs of them. What belongs to a name is kept once for each different name."""

    def __init__(self, names: list[str] | pa.Array, born: np.ndarray, email: np.ndarray, post: np.ndarray, known: Evidence):
        """born is 0 where unknown, as are email and post."""
        self.known, self.born, self.email, self.post = known, born, email, post
        told = (names if isinstance(names, pa.Array) else pa.array(names, pa.string())).dictionary_encode()
        self.code, self.names = told.indices.to_numpy(zero_copy_only=False).astype("i8"), told.dictionary
        plain = lambda x: pc.ascii_trim_whitespace(pc.replace_substring_regex(x, "[| ]+", " "))
        count = lambda x: np.where(pc.equal(x, "").to_numpy(zero_copy_only=False), 0, pc.count_substring(x, " ").to_numpy(zero_copy_only=False) + 1).astype("i8")
        self.plain = plain(self.names)
        # a name's parts: how many, where the surname begins, and the place of the first name (where there is none the surname's last part)
        self.size, self.surname = count(self.plain), count(plain(pc.replace_substring_regex(self.names, r"\|[^|]*$", "")))
        self.first = np.where(self.surname > 0, 0, np.maximum(0, self.size - 1))
        self.start = np.cumsum(self.size) - self.size
        parts = pc.list_flatten(pc.split_pattern(self.plain.filter(pa.array(self.size > 0)), " ")).dictionary_encode()
        self.part, self.words = parts.indices.to_numpy(zero_copy_only=False).astype("i8"), parts.dictionary.to_pylist()
        table, most = known.parts, known.most
        self.word_bits = np.array([table.get(w, most) for w in self.words], float)
        self.word_rare = np.array([w not in table for w in self.words], bool)
        self._letters: tuple[np.ndarray, ...] | None = None
        self._sets: tuple[np.ndarray, np.ndarray] | None = None
        days, at = np.unique(born, return_inverse=True)
        self.born_bits = np.array([known.born.get(v, most) for v in days.tolist()], float)[at]

    def most_bits(self) -> np.ndarray:
        """What each different name's parts can give at most."""
        return np.bincount(np.repeat(np.arange(len(self.size)), self.size), np.maximum(2.5, self.word_bits)[self.part], len(self.size)) if len(self.part) else np.zeros(len(self.size))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The padded 2-grams of all parts of the different names, as codes in one flat array, and how many each name has."""
        if not len(self.plain):
            return np.zeros(0, "u4"), np.zeros(0, "i8")
        padded = pc.binary_join_element_wise("", self.plain, "", " ")
        ends = np.frombuffer(padded.buffers()[1], "i4")[padded.offset : padded.offset + len(padded) + 1].astype("i8")
        flat = np.frombuffer(padded.buffers()[2] or b"", "u1")[ends[0] : ends[-1]].astype("u4")
        ends -= ends[0]
        code, inside = np.zeros(len(flat), "u4"), np.repeat(self.size > 0, np.diff(ends))
        if len(flat):
            code[:-1] = flat[:-1] * 256 + flat[1:]
        inside[ends[1:][self.size > 0] - 1] = False
        return code[inside], np.where(self.size > 0, np.diff(ends) - 1, 0)

    def signature(self, hashes: int) -> np.ndarray:
        """MinHash values of the names' grams, one row per record; names without grams get their own values."""
        code, size = self.grams()
        rng = np.random.default_rng(20)
        a, b = rng.integers(1, 1 << 62, hashes, "u8") | np.uint64(1), rng.integers(0, 1 << 62, hashes, "u8")
        out = np.zeros((len(size), hashes), "u4")
        full = size > 0
        starts = (np.cumsum(size) - size)[full]
        different, at = np.unique(code, return_inverse=True)
        for h in range(hashes if len(starts) else 0):
            x = ((different.astype("u8") * a[h] + b[h]) >> np.uint64(32)).astype("u4")
            out[full, h] = np.minimum.reduceat(x[at], starts)
        out = out[self.code]
        bare = ~full[self.code]
        out[bare] = np.arange(bare.sum())[:, None]
        return out

    def share(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Dice's coefficient of the names' grams as bit sets, for a quick look at how much two names share."""
        if self._sets is None:
            code, size = self.grams()
            out = np.zeros((len(size), GRAM_BITS), bool)
            out[np.repeat(np.arange(len(size)), size), (code * np.uint32(2654435761)) >> np.uint32(24)] = True
            bits = np.packbits(out, axis=1).view("u8")
            self._sets = np.ascontiguousarray(bits.T), out.sum(1)
        bits, size = self._sets
        a, b = self.code[i], self.code[j]
        both = np.zeros(len(a), "u2")
        for column in bits:
            both += np.bitwise_count(column[a] & column[b])
        return 2 * both / np.maximum(1, size[a] + size[b])

    def dates(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits of the birth dates: equal, day and month exchanged, one part of three differs, or different."""
        a, b = self.born[i], self.born[j]
        part = lambda x: (x // 10000, x // 100 % 100, x % 100)
        (ya, ma, da), (yb, mb, db) = part(a), part(b)
        rarity = self.born_bits[i]
        same = (ya == yb).astype(int) + (ma == mb) + (da == db)
        out = np.where(a == b, rarity, np.where((ya == yb) & (ma == db) & (da == mb), rarity - 4, np.where(same == 2, TWO_PARTS, -6.0)))
        return np.where((a == 0) | (b == 0), 0.0, out)

    def contact(self, which: str, i: np.ndarray, j: np.ndarray, differs: float) -> np.ndarray:
        """Bits of an address: its rarity where equal, differs where not, 0 where unknown."""
        column, table = getattr(self, which), getattr(self.known, which)
        a, b = column[i], column[j]
        out = np.where((a == 0) | (b == 0), 0.0, differs)
        eq = np.flatnonzero((a == b) & (a != 0))
        most = self.known.most
        out[eq] = [table.get(v, most) for v in a[eq].tolist()] if table else most
        return out

    def _part_likeness(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Likeness of parts by number, compared once each; most that are unlike are told by the letters they share."""
        if self._letters is None:
            words = self.words
            size = np.fromiter(map(len, words), "i8", len(words))
            flat = np.frombuffer("".join(words).encode("ascii"), "u1").astype("i8") - 97
            letters = np.bincount(np.repeat(np.arange(len(words)), size) * 26 + flat, minlength=len(words) * 26).reshape(-1, 26).astype("i4")
            ends = np.cumsum(size)
            self._letters = letters, size, flat[ends - size], flat[ends - 1], np.array([w in _FULL for w in words], bool)
        letters, size, head, tail, short = self._letters
        out = (x == y).astype(float)
        open_ = np.flatnonzero(out == 0)
        pairs, back = np.unique(np.minimum(x[open_], y[open_]) * len(self.words) + np.maximum(x[open_], y[open_]), return_inverse=True)
        a, b = pairs // len(self.words), pairs % len(self.words)
        may = (size[a] == 1) | (size[b] == 1) | short[a] | short[b] | (head[a] == head[b]) | (tail[a] == tail[b])
        at = np.flatnonzero(~may)
        shared = np.minimum(letters[a[at]], letters[b[at]]).sum(1)
        may[at] = shared >= LEAST_ALIKE * np.maximum(size[a[at]], size[b[at]])
        like, get, words = np.zeros(len(pairs)), part_alike, self.words
        at = np.flatnonzero(may)
        like[at] = [get(words[p], words[q]) for p, q in zip(a[at].tolist(), b[at].tolist(), strict=True)]
        out[open_] = like[back]
        return out

    def compare(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of names, by number: bits, Monge-Elkan likeness, whether the first names contradict each other, and the rare parts both have (which pair, which part).

        Parts are paired by likeness, each once; a pair gives the rarity of its part, less if it is
        only alike.
        """
        bits, like, against = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a), bool)
        rare_pair, rare_part = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        shape = self.size[a] * (self.size.max(initial=0) + 1) + self.size[b]
        order = np.argsort(shape, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1) if len(order) else ():
            p, q = int(self.size[a[own[0]]]), int(self.size[b[own[0]]])
            if not p or not q:
                continue
            for at in np.array_split(own, len(own) * p * q // COMPARED + 1):
                bits[at], like[at], against[at], n, w = self._compare(a[at], b[at], p, q)
                rare_pair.append(at[n])
                rare_part.append(w)
        return bits, like, against, np.concatenate(rare_pair), np.concatenate(rare_part)

    def _compare(self, a: np.ndarray, b: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """compare() for names of p and q parts."""
        k = len(a)
        x, y = self.part[self.start[a][:, None] + np.arange(p)], self.part[self.start[b][:, None] + np.arange(q)]
        s = self._part_likeness(np.repeat(x, q, axis=1).ravel(), np.tile(y, p).ravel()).reshape(k, p, q)
        like = (s.max(2) if p <= q else s.max(1)).mean(1)
        met_a, met_b = np.full((k, p), -1), np.full((k, q), -1)
        bits, rare_pair, rare_part = np.zeros(k), [], []
        initial = np.array([len(w) == 1 for w in self.words], bool)
        for _ in range(min(p, q)):
            best = s.reshape(k, p * q).argmax(1)
            at = np.flatnonzero(s.reshape(k, p * q)[np.arange(k), best] >= LIKE)
            if not len(at):
                break
            m, n = best[at] // q, best[at] % q
            alike_ = s[at, m, n]
            met_a[at, m], met_b[at, n] = n, m
            s[at, m, :] = -1
            s[at, :, n] = -1
            u, v = x[at, m], y[at, n]
            near = np.minimum(np.minimum(self.word_bits[u], self.word_bits[v]), MOST_ALIKE) * np.where(alike_ >= CLOSE, 0.65, 0.4)
            letter, same = initial[u] | initial[v], u == v
            bits[at] += np.where(letter, 2.5, np.where(same, self.word_bits[u], near))
            rare = same & ~letter & self.word_rare[u]
            rare_pair.append(at[rare])
            rare_part.append(u[rare])
        left_a, left_b = (met_a < 0).sum(1), (met_b < 0).sum(1)
        bits -= 4.5 * np.minimum(left_a, left_b)  # parts on both sides that answer to nothing
        # a first name is lost that answers to nothing, or, with something left on its side, to a surname (fields exchanged)
        rows = np.arange(k)
        to_a, to_b = met_a[rows, self.first[a]], met_b[rows, self.first[b]]
        lost_a = (to_a < 0) | ((left_a > 0) & (to_a >= self.surname[b]) & (to_b < 0))
        lost_b = (to_b < 0) | ((left_b > 0) & (to_b >= self.surname[a]) & (to_a < 0))
        return bits, like, lost_a & lost_b, np.concatenate(rare_pair or [rows[:0]]), np.concatenate(rare_part or [rows[:0]])

    def name_bits(self, i: int, j: int) -> tuple[float, float, bool]:
        """Bits of two records' names, their likeness, and whether the first names contradict each other."""
        bits, like, against, _, _ = self.compare(self.code[[i]], self.code[[j]])
        return float(bits[0]), float(like[0]), bool(against[0])


@dataclass
class Weights:
    """Pairs that were weighed: bits (-inf where the records contradict each other), likeness of names, and their rare values."""

    batch: Batch
    i: np.ndarray
    j: np.ndarray
    total: np.ndarray
    like: np.ndarray
    names: np.ndarray
    rare_pair: np.ndarray
    rare_part: np.ndarray

    def columns(self, keep: np.ndarray) -> list[pa.Array]:
        """The columns PAIR of the pairs at these places."""
        batch, i, j = self.batch, self.i[keep], self.j[keep]
        both = []
        for column, table in ((batch.email, batch.known.email), (batch.post, batch.known.post)):
            no = (column[i] != column[j]) | (column[i] == 0)
            if table:
                no |= np.isin(column[i], np.fromiter(table, "i8", len(table)))
            both.append(pa.array(column[i], pa.int64(), mask=no))
        pair, own = self.names[keep], np.argsort(self.rare_pair, kind="stable")
        start, stop = np.searchsorted(self.rare_pair[own], pair), np.searchsorted(self.rare_pair[own], pair, "right")
        size = stop - start
        flat = self.rare_part[own][np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        words = pa.array(batch.words, pa.string()).take(pa.array(flat, pa.int64()))
        offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32())
        return [pa.array(self.total[keep]), *both, pa.ListArray.from_arrays(offsets, words)]


def weigh(batch: Batch, i: np.ndarray, j: np.ndarray, differs_email: float = -1.5, differs_post: float = -1.0) -> Weights:
    """The bits of all evidence for each pair, and the names' likeness.

    Two different first names contradict, as of twins, who share birth dates, homes and mailboxes; so
    do birth years a generation apart, as of a parent of the same name.
    """
    other = batch.dates(i, j) + batch.contact("email", i, j, differs_email) + batch.contact("post", i, j, differs_post)
    a, b = batch.born[i], batch.born[j]
    apart = (a != 0) & (b != 0) & (np.abs(a // 10000 - b // 10000) >= GENERATION)
    pairs, names = np.unique(batch.code[i] * len(batch.names) + batch.code[j], return_inverse=True)
    bits, like, against, rare_pair, rare_part = batch.compare(pairs // max(1, len(batch.names)), pairs % max(1, len(batch.names)))
    return Weights(batch, i, j, np.where(apart | against[names], -np.inf, other + bits[names]), like[names], names, rare_pair, rare_part)


#: Fields of a pair in an Arrow batch, after its keys.
PAIR_NAMES = ["bits", "email", "post", "words"]
