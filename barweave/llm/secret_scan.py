"""Secrets: patterns with exact spans, and a randomness test battery with false-discovery control.

Everything is DataFrame operations. The three base patterns give the spans ``assign``, ``access`` and ``hex``. Other
runs of at least 20 characters of [A-Za-z0-9+/_=-] are candidates if their encoding can be inferred:

* hex: digits and letters of one case up to f, both present; base32: A-Z and 2-7, both present;
* lower and upper: letters of one case, with or without digits;
* base64: any other with a lower-case letter and a capital.

The parts of a run between the characters /, =, _ and - are candidates too if they have 20 characters, as a secret may
be glued to readable text. Of candidates that pass, those inside another one that passes are dropped.

A candidate must look random: the chi-squared statistic of its characters against a uniform alphabet, the runs test of
its values about the alphabet's middle, and their lag-1 serial correlation, each as a normal deviate, may not be
extreme (together ``battery`` false alarms). And it must not look written, by the same three sides of a string: how
often each letter stands (frequencies), how often the class of characters changes (runs), and how vowels and consonants
follow each other (serial dependence). Each gives the logarithm of its likelihood as a random string of the encoding
over that as written text; exp(-sum) bounds the probability of so much evidence in written text, whatever the length,
and so is its p-value. These p-values are put under the step-up rule of Benjamini and Hochberg within four classes of
length at the rate ``discovery``; the rule reads a histogram of at most 121 levels for each class, so that no candidate
is sorted or gathered. Candidates that pass are spans of the kind ``random`` unless a base span overlaps.

Defined cases: a null text is empty and has no spans; texts of any length are searched whole; repeated rows and null
ids stay as they are; other columns are kept, those with the names of results replaced; an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Fixed patterns. A kind's number is its place; spans that start together are in this order.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
PART = r"[A-Za-z0-9+]{20,}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabet of each encoding in the order of its values.
ENCODINGS = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "base64": UPPER + LOWER + DIGITS + "+/"}
ENCODINGS |= {f"{case}{kind}": letters + digits for case, letters in (("lower", LOWER), ("upper", UPPER)) for kind, digits in (("36", DIGITS), ("26", ""))}
#: Fixed values, rough means over European languages: each letter's rate in written text (no rate below 4 per mille),
#: the chance of a vowel at a start, after a vowel and after a consonant, and what class of character follows which
#: (l: lower case, u: upper case, d: digit, o: + or /) in names, paths and identifiers.
LETTER_RATES = dict(a=75, b=15, c=32, d=42, e=140, f=15, g=17, h=30, i=70, j=4, k=6, l=48, m=28, n=75, o=62, p=24, q=6, r=68, s=70, t=68, u=42, v=14, w=10, x=4, y=10, z=6)
VOWELS, VOWEL_CHANCE = "aeiou", (0.4, 0.2, 0.5)
FOLLOWS = {"l": dict(l=0.80, u=0.12, d=0.05, o=0.03), "u": dict(l=0.60, u=0.30, d=0.07, o=0.03), "d": dict(l=0.20, u=0.15, d=0.60, o=0.05), "o": dict(l=0.55, u=0.25, d=0.15, o=0.05)}
#: Classes of length: from so many characters on.
CLASSES = (48, 32, 24, 20)
LEVELS = 120


def char_class(char: str) -> str:
    return "l" if char in LOWER else "u" if char in UPPER else "d" if char in DIGITS else "o"


def class_evidence(encoding: str) -> dict[str, float]:
    """For each pair of neighbouring classes: log likelihood of the second in the random encoding over that in written text."""
    classes = Counter(map(char_class, ENCODINGS[encoding]))
    share = {c: n / classes.total() for c, n in classes.items()}
    return {a + b: math.log(share[b] / (FOLLOWS[a][b] / sum(FOLLOWS[a][c] for c in classes))) for a in classes for b in classes}


def letter_evidence() -> list[float]:
    """The same for each letter a to z at a start, after a vowel, and after a consonant."""
    group = {c: sum(n for x, n in LETTER_RATES.items() if (x in VOWELS) == (c in VOWELS)) for c in LOWER}
    written_rate = lambda c, chance: (chance if c in VOWELS else 1 - chance) * LETTER_RATES[c] / group[c]
    return [math.log(1 / 26 / written_rate(c, chance)) for chance in VOWEL_CHANCE for c in LOWER]


def _spans(text: Column, pattern: str, kind: int, value_group: int, least: int) -> Column:
    """Spans of the leftmost matches that do not overlap, those whose group is shorter than ``least`` dropped.

    Each piece is a match with the text since the one before; the end of the k-th match is the length of k pieces.
    """
    whole = rf"\G(?s:.*?)({pattern})"
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    pieces, matches, values = (F.regexp_extract_all(text, F.lit(whole), F.lit(i)) for i in (0, 1, value_group))
    sizes = F.zip_with(F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m"))), values, lambda s, v: F.struct(s["p"].alias("p"), s["m"].alias("m"), F.length(v).alias("v")))
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + s["p"]
        span = F.struct((end - s["m"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["v"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(sizes, first, step)["out"]).otherwise(empty)


def _tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by an approximation good to 1e-5 in the middle and 1 % far out."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _encoding(token: Column) -> Column:
    has = lambda cls: token.rlike(cls)
    return (
        F.when((token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$")) & has("[0-9]") & has("[A-Fa-f]"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$") & has("[A-Z]") & has("[2-7]"), "base32")
        .when(token.rlike("^[a-z]+=*$"), "lower26")
        .when(token.rlike("^[A-Z]+=*$"), "upper26")
        .when(token.rlike("^[a-z0-9]+=*$") & has("[a-z]"), "lower36")
        .when(token.rlike("^[A-Z0-9]+=*$") & has("[A-Z]"), "upper36")
        .when(has("[a-z]") & has("[A-Z]"), "base64")
    )


def candidates(text: Column) -> Column:
    """Array of (start, end, token, encoding) of the runs and their parts whose encoding can be inferred."""
    return F.when(text.rlike(CANDIDATE), F.array_distinct(F.concat(_runs(text, CANDIDATE), _runs(text, PART)))).otherwise(F.array().cast("array<struct<start:int,end:int,token:string,encoding:string>>"))


def _runs(text: Column, pattern: str) -> Column:
    whole = rf"\G(?s:.*?)({pattern})"
    pieces, tokens = (F.regexp_extract_all(text, F.lit(whole), F.lit(i)) for i in (0, 1))
    empty = F.array().cast("array<struct<start:int,end:int,token:string,encoding:string>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["p"])
        found = F.struct((end - F.length(s["t"])).alias("start"), end.alias("end"), s["t"].alias("token"), _encoding(s["t"]).alias("encoding"))
        return F.struct(end.alias("at"), F.when(found["encoding"].isNotNull(), F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(pieces, tokens, lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, first, step)["out"]).otherwise(empty)


def _statistics(found: Column) -> Column:
    """The candidate's characters with the alphabet of its encoding and its table of class evidence."""
    normal = F.when(found["encoding"] == "hex", F.lower(found["token"])).otherwise(F.translate(found["token"], "-_", "+/"))
    body = F.translate(normal, "=", "")
    alphabet, evidence = F.lit(""), F.lit(None).cast("map<string,double>")
    for name, letters in ENCODINGS.items():
        alphabet = F.when(found["encoding"] == name, F.lit(letters)).otherwise(alphabet)
        table = F.create_map(*(F.lit(x) for pair in class_evidence(name).items() for x in pair))
        evidence = F.when(found["encoding"] == name, table).otherwise(evidence)
    # in hex the letters are no writing
    letters = F.when(found["encoding"] == "hex", F.lit("")).otherwise(F.lower(body))
    return F.struct(found["start"].alias("start"), found["end"].alias("end"), body.alias("body"), letters.alias("letters"), alphabet.alias("alphabet"), evidence.alias("evidence"))


def _values(found: Column) -> Column:
    chars = F.split(found["body"], "(?!$)")
    classes = F.split(F.translate(found["body"], LOWER + UPPER + DIGITS + "+/", "l" * 26 + "u" * 26 + "d" * 10 + "oo"), "(?!$)")
    letters = F.transform(F.split(found["letters"], "(?!$)"), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(LOWER), c)))
    return F.struct(
        *(found[c].alias(c) for c in ("start", "end", "evidence")),
        F.length(found["body"]).cast("double").alias("n"),
        F.length(found["alphabet"]).cast("double").alias("k"),
        F.transform(chars, lambda c: F.instr(found["alphabet"], c).cast("double")).alias("v"),
        F.transform(F.array_distinct(chars), lambda c: (F.length(found["body"]) - F.length(F.replace(found["body"], c, F.lit("")))).cast("double")).alias("counts"),
        classes.alias("classes"),
        letters.alias("letters"),
    )


def _neighbours(values: Column, of) -> Column:
    """What ``of`` gives for each value and the next one."""
    n = F.size(values)
    return F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), of)


def _evidence(found: Column) -> Column:
    """Log likelihood as a random string over that as written text."""
    classes = _neighbours(found["classes"], lambda a, b: F.element_at(found["evidence"], F.concat(a, b)))
    kinds = F.array(*(F.lit(k) for k in (0, *(1 if c in VOWELS else 2 for c in LOWER))))
    table = F.array(*map(F.lit, letter_evidence()))
    at = lambda a, b: F.when(b > 0, F.get(table, F.get(kinds, a) * 26 + b - 1)).otherwise(0.0)
    letters = _neighbours(F.concat(F.array(F.lit(0)), found["letters"]), at)
    return _sum(classes) + _sum(letters)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _sums(found: Column) -> Column:
    mean = _sum(found["v"]) / found["n"]
    high = F.transform(found["v"], lambda v: F.when(v > found["k"] / 2, 1.0).otherwise(0.0))
    return F.struct(
        *(found[c].alias(c) for c in ("start", "end", "n", "k")),
        _evidence(found).alias("written"),
        _sum(F.transform(found["counts"], lambda c: c * c)).alias("squares"),
        mean.alias("mean"),
        found["v"].alias("v"),
        high.alias("high"),
        _sum(high).alias("n_high"),
    )


def _deviates(found: Column) -> Column:
    n, k, ones, mean = found["n"], found["k"], found["n_high"], found["mean"]
    zeros = n - ones
    chi = k / n * found["squares"] - n
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    later = F.slice(found["high"], F.lit(2), F.size(found["high"]))
    runs = 1 + _sum(F.zip_with(F.slice(found["high"], F.lit(1), F.size(found["high"]) - 1), later, lambda a, b: F.abs(a - b)))
    mid = 2 * ones * zeros / n + 1
    z_runs = F.when((ones > 1) & (zeros > 1), (runs - mid) / F.sqrt((mid - 1) * (mid - 2) / (n - 1))).otherwise(F.lit(99.0))
    moved = F.zip_with(F.slice(found["v"], F.lit(1), F.size(found["v"]) - 1), F.slice(found["v"], F.lit(2), F.size(found["v"])), lambda a, b: (a - mean) * (b - mean))
    around = _sum(F.transform(found["v"], lambda v: (v - mean) * (v - mean)))
    z_serial = F.when(around > 0, _sum(moved) / around * F.sqrt(n)).otherwise(F.lit(99.0))
    return F.struct(found["start"].alias("start"), found["end"].alias("end"), n.alias("n"), z_chi.alias("chi"), F.abs(z_runs).alias("runs"), F.abs(z_serial).alias("serial"), found["written"].alias("written"))


def _level(found: Column) -> Column:
    size = F.lit(None).cast("int")
    for n, least in enumerate(reversed(CLASSES)):
        size = F.when(found["n"] >= least, F.lit(n)).otherwise(size)
    size = F.coalesce(size, F.lit(0))
    worst = F.least(2 * _tail(F.abs(found["runs"])), 2 * _tail(F.abs(found["serial"])), 2 * _tail(F.abs(found["chi"])))
    level = F.least(F.floor(4 * F.greatest(found["written"], F.lit(0.0))), F.lit(LEVELS)).cast("int")
    return F.struct(found["start"].alias("start"), found["end"].alias("end"), size.alias("size"), worst.alias("worst"), level.alias("level"))


def scan(docs: DataFrame, text_col: str = "text", keep_text: bool = True, battery: float = 0.001, discovery: float = 0.01) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, kind, end) by start and kind, in code points."""
    own = [c for c in docs.columns if c not in ("base_spans", "spans")]
    text = F.col("_bw_text")
    found = docs.select(*own, F.coalesce(text_col, F.lit("")).alias("_bw_text"))
    found = found.withColumns(
        {
            "_bw_assign": _spans(text, ASSIGN, 0, 2, 8),
            "_bw_access": _spans(text, ACCESS, 1, 1, 16),
            "_bw_hex": _spans(text, HEX, 2, 1, 32),
            "_bw_candidates": candidates(text),
        }
    ).drop("_bw_text", *([] if keep_text else [text_col]))
    found = found.withColumn("base_spans", F.array_sort(F.concat("_bw_assign", "_bw_access", "_bw_hex"))).drop("_bw_assign", "_bw_access", "_bw_hex")
    alone = F.filter("_bw_candidates", lambda c: ~F.exists("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = found.withColumn("_bw_candidates", F.when(F.size("_bw_candidates") > 0, alone).otherwise(F.col("_bw_candidates")))
    for stage in (_statistics, _values, _sums, _deviates, _level):
        found = found.withColumn("_bw_candidates", F.transform("_bw_candidates", stage))
    found = written(found, "secret-candidates")
    levels = (
        found.select(F.explode("_bw_candidates").alias("c"))
        .select("c.size", F.when(F.col("c.worst") >= battery / 3, F.col("c.level")).otherwise(-1).alias("level"))
        .groupBy("size", "level")
        .count()
        .collect()  # four classes with at most LEVELS + 2 levels
    )
    cuts = [cut_level({r.level: r["count"] for r in levels if r.size == size}, discovery) for size in range(len(CLASSES))]
    cut = F.array(*map(F.lit, cuts))
    random = F.transform(
        F.filter("_bw_candidates", lambda c: (c["worst"] >= battery / 3) & (c["level"] >= F.get(cut, c["size"]))),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")),
    )
    ordered = F.array_sort(F.transform(random, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"))))
    found = found.withColumn("_bw_random", random).withColumn("_bw_ordered", F.when(F.size("_bw_random") > 1, ordered))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:  # runs do not overlap: what starts before the last end is a part of it
        span = F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), (-c["back"]).alias("end"))
        fresh = c["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], -c["back"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    outer = F.when(F.size("_bw_random") > 1, F.aggregate("_bw_ordered", first, step)["out"]).otherwise(F.col("_bw_random"))
    return found.withColumn("spans", F.array_sort(F.concat("base_spans", outer))).drop("_bw_candidates", "_bw_random", "_bw_ordered")


def cut_level(counts: dict[int, int], discovery: float) -> int:
    """The lowest level at which the expected false discoveries are a share of at most ``discovery`` of those found."""
    total, held, cut = sum(counts.values()), 0, LEVELS + 1
    for level in range(LEVELS, -1, -1):
        held += counts.get(level, 0)
        if held and total * math.exp(-level / 4) <= discovery * held:
            cut = level
    return cut


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of their texts, overlapping ones together, replaced by the mask."""
    found = scan(docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text")), keep_text=False, **options)
    text = F.col("doc")[text_col]
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate("spans", first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    masked = F.when(F.size("spans") > 0, done).otherwise(text)
    return found.select(F.col("doc").withField(text_col, masked).alias("doc")).select("doc.*")
