"""Source divergence audit: how far the vocabulary of each source of a language lies from every other source's and from
the language's own, in exact integers, with relational operations alone.

Terms are runs of letters (A-Z in lower case; every character beyond ASCII counts as a letter). A language keeps the
terms that occur in at least ``least_docs`` of its documents; V is their number. In a group (language and source) or a
whole language a kept term that occurs ``count`` times has the share p = 1 + floor(10^9 * (count + 1) / (N + V)), N the
occurrences of all kept terms there. Its divergence from a share q is floor((p - q)^2 / q).

One pass explodes the terms of each document and once more its distinct ones, so that the same sums count occurrences
and documents; what is shuffled is a row for each group and term. Groups and kept terms get numbers, and a
written table has a row for each kept term with its counts by group. The kept terms meet the groups of their language
(every zero becomes a row) in slots of terms, as a language is one key; the dense rows are joined with themselves on
the term's number, each pair once for both directions, and its pairs are summed before they are shuffled. Of the raised
terms only those whose value can be among the first are sorted: those from the power of two on that enough others reach.

Defined cases: null text, language or source counts as the empty string; a group whose documents have no term has the
count zero for every kept term; a language without kept terms gives its pairs the value 0 and no terms; every row is a
document, so repeated rows count again; ties in rank go by the item's UTF-8 bytes; texts are read whole; an empty table
gives no rows; other columns, of whatever name, are not read. Shares add up to 10^9 + V at most, so that a sum fits a
long for V below 2 * 10^9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import lower_ascii, written

#: A term is a match of [^\x00-\x40\x5B-\x60\x7B-\x7F]+ (ASCII letters and everything beyond ASCII): what stands between matches of this.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, MOST_TERMS = 3, 200
#: Slots in which the kept terms of a language meet its groups.
SLOTS = 64


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in a group, and the group's documents that have it."""
    text = _text("text")
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_ascii(text))
    rows = docs.select(_text("lang").alias("lang"), _text("source").alias("source"), F.array_remove(F.split(lowered, BETWEEN), "").alias("all"))
    number = lambda n: F.lit(n).cast("long")
    lists = F.array(F.struct(number(1).alias("n"), number(0).alias("docs"), F.col("all").alias("terms")), F.struct(number(0).alias("n"), number(1).alias("docs"), F.array_distinct("all").alias("terms")))
    each = rows.select("lang", "source", F.inline(lists)).select("lang", "source", "n", "docs", F.explode("terms").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + kept)), beyond 64 bits where it has to be."""
    wide = f"(cast({n} + 1 as decimal(20, 0)) * cast(1000000000 as decimal(10, 0))) div cast({total} + {kept} as decimal(20, 0))"
    return F.lit(1) + F.expr(f"if({n} < 9000000000, (({n} + 1) * 1000000000) div ({total} + {kept}), {wide})")


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms (t, lang, term, lang_n, held: array of g and n) and groups (g, lang, source, total, lang_total, v)."""
    groups = docs.select(_text("lang").alias("lang"), _text("source").alias("source")).distinct()
    groups = written(groups.withColumn("g", F.monotonically_increasing_id()), "divergence-groups")
    counts = term_counts(docs).join(groups, ["lang", "source"])
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("g", "n")).alias("held"))
    kept = written(kept.where(F.col("docs") >= least_docs).drop("docs").withColumn("t", F.monotonically_increasing_id()), "divergence-terms")
    of_lang = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("v"))
    of_group = kept.select(F.inline("held")).groupBy("g").agg(F.sum("n").alias("total"))
    sized = groups.join(of_group, "g", "left").join(of_lang, "lang", "left")
    return kept, written(sized.fillna(0, ["total", "lang_total", "v"]), "divergence-sizes")


def dense_shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(t, g, p) for every group and kept term of its language."""
    slots = groups.select("lang", "g", "total", "v", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    terms = kept.select("t", "lang", F.map_from_entries("held").alias("held"), F.pmod("t", F.lit(SLOTS)).cast("int").alias("slot"))
    met = terms.join(slots, ["lang", "slot"]).select("t", "g", "total", "v", F.coalesce(F.col("held")[F.col("g")], F.lit(0)).alias("n"))
    return met.select("t", "g", _share("n", "total", "v").alias("p"))


def raised_terms(kept: DataFrame, groups: DataFrame, most_terms: int) -> DataFrame:
    """(g, item, value, rank) of each group's terms with the largest divergence from their language."""
    rows = kept.select("term", "lang_n", F.inline("held")).join(groups.select("g", "total", "lang_total", "v"), "g")
    rows = rows.withColumns({"p": _share("n", "total", "v"), "q": _share("lang_n", "lang_total", "v")}).where("p > q").select("g", F.col("term").alias("item"), _divergence("p", "q").alias("value"))
    order = F.floor(F.log2(F.col("value") + 1)).cast("int")  # never falls as the value rises
    sizes = rows.groupBy("g", order.alias("power")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("g").orderBy(F.col("power").desc())
    above = sizes.withColumn("reached", F.sum("n").over(down)).where(F.col("reached") >= most_terms)
    bars = written(above.groupBy("g").agg(F.max("power").alias("bar")), "divergence-bars")
    rows = rows.join(bars, "g", "left").where(F.col("bar").isNull() | (order >= F.col("bar")))
    best = Window.partitionBy("g").orderBy(F.col("value").desc(), "item")
    return rows.select("g", "item", "value", F.row_number().over(best).alias("rank")).where(F.col("rank") <= most_terms)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's divergence from the other sources of its language, and its most raised terms.

    Part ``pair`` has every other source; part ``term`` the ``most_terms`` terms with the largest divergence from the
    language among those that the group has and that are more frequent there.
    """
    kept, groups = kept_terms(docs, least_docs)
    names = groups.select("g", "lang", "source")
    dense = dense_shares(kept, groups)
    near, far = dense, dense.select("t", F.col("g").alias("g2"), F.col("p").alias("q"))
    met = near.join(far, "t").where("g < g2").select("g", "g2", _divergence("p", "q").alias("there"), _divergence("q", "p").alias("back"))
    sums = met.groupBy("g", "g2").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    sums = sums.select(F.inline(F.array(F.struct("g", "g2", F.col("there").alias("value")), F.struct(F.col("g2").alias("g"), F.col("g").alias("g2"), F.col("back").alias("value")))))
    pairs = names.join(names.select("lang", F.col("g").alias("g2"), F.col("source").alias("item")), "lang").where("g != g2").join(sums, ["g", "g2"], "left")
    order = Window.partitionBy("g").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("value", F.coalesce("value", F.lit(0))).withColumn("rank", F.row_number().over(order))
    raised = raised_terms(kept, groups, most_terms).join(names, "g")
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return pairs.select(*columns("pair")).unionByName(raised.select(*columns("term")))
