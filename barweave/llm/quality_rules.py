"""Quality rules with adaptive thresholds: quantile sketches per language and source instead of fixed cutoffs.

Everything is DataFrame operations. Each document gets its counts once. The sketch of a metric is a histogram over
integers cut to their six leading bits (so a quantile is off by 3 % at most); it is a table of counts, and sketches
merge by adding: (language, source) sketches give those of a language and of all documents. Most documents have no
repeated line or window at all, so the sketches of these two metrics hold only the documents that have one.

The fences of a group (language and source) come from its sketch's median and its spread, the distance from the lower
quartile to the median (for the mean word length, which has a fence on either side, the smaller of both distances), so
that bad documents move neither much while they are fewer than half. A language has the medians of both over its
sources, each with one vote, however large it is. A group leans on its language with the weight of ``prior`` documents
and has at least the language's spread (that of all groups where it is zero; where that is zero too the metric decides
nothing). A document's metric may rise to median + reach * spread, and the word length may fall as far below, but no
further from the language's median than twice the reach in the language's spreads, to each of which the median distance
of its sources' medians is added: a source that is bad for the most part doesn't set its own fence among like ones, and
sources of different kinds do. Metrics whose sketch leaves zeros out have a long upper side and twice the reach. No fence is
a constant.
Base rules (word count, repeated 3-word windows) come first; documents that fail them neither enter the sketches nor
are kept. ``failed_rules`` names what a document fails.

Defined cases: null and empty texts have no words and fail the base rules; very long texts are counted whole; null
language or source is the empty string; ties and repeated rows count as rows; other columns are kept, those with the
names of results replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import UPPER, words_of, written

SYMBOLS = "#*$%&|<>"
#: ASCII characters that are neither letters, digits nor white space.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Integer metrics with upper fences, those of them whose sketch leaves zeros out, and the one with fences on both sides.
UPPER_FENCE, NO_ZEROS, LENGTH = ("marks_per_mille", "capitals_per_mille", "dup_lines_per_mille", "repeats_per_mille"), ("dup_lines_per_mille", "repeats_per_mille"), "word_length_percent"
METRICS = (*UPPER_FENCE, LENGTH)
#: Thresholds of up to this many groups are broadcast (about 100 bytes each); more are joined by a salted shuffle.
BROADCAST_GROUPS = 20_000
SALTS = 32


def document_counts(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the metrics made of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    own = [c for c in docs.columns if c not in RESULTS]
    found = docs.select(*own).withColumns({"_bw_text": text, "_bw_words": words_of(F.col(text_col)), "_bw_lines": lines})
    found = found.withColumns(
        {
            "n_words": F.size("_bw_words").cast("long"),
            "word_chars": F.length(F.translate("_bw_text", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length("_bw_text") - F.length(F.translate("_bw_text", SYMBOLS, ""))).cast("long"),
            "_bw_marks": (F.length("_bw_text") - F.length(F.translate("_bw_text", MARKS, ""))).cast("long"),
            "_bw_capitals": (F.length("_bw_text") - F.length(F.translate("_bw_text", UPPER + "!", ""))).cast("long"),
            "_bw_n_lines": F.size("_bw_lines"),
            "n_dup_lines": (F.size("_bw_lines") - F.size(F.array_distinct("_bw_lines"))).cast("long"),
            "_bw_windows": F.transform(F.slice("_bw_words", F.lit(3), F.greatest(F.size("_bw_words"), F.lit(1))), lambda word, i: F.concat_ws(" ", F.col("_bw_words")[i], F.col("_bw_words")[i + 1], word)),
        }
    ).drop("_bw_text", "_bw_words", "_bw_lines")
    # only texts with an equal pair of windows go on: equal windows stand together once sorted with their places
    found = found.withColumn("_bw_sorted", F.when(F.size(F.array_distinct("_bw_windows")) < F.size("_bw_windows"), F.sort_array(F.transform("_bw_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    found = found.drop("_bw_windows").withColumn(
        "_bw_starts",
        F.filter(
            F.transform("_bw_sorted", lambda x, k: F.when((F.get("_bw_sorted", k - 1)["w"] == x["w"]) | (F.get("_bw_sorted", k + 1)["w"] == x["w"]), x["i"])),
            lambda i: i.isNotNull(),
        ),
    )
    found = found.drop("_bw_sorted").withColumn(
        "n_repeat_words", F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("_bw_starts", lambda i: F.array(i, i + 1, i + 2))))).cast("long"), F.lit(0))
    )
    found = found.withColumn("n_repeat_words", F.when(F.col("_bw_starts").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_repeat_words"))).drop("_bw_starts")

    def ratio(top: Column, bottom: Column, times: int) -> Column:
        return F.when(bottom > 0, F.expr("1L") * times * top / bottom).otherwise(0).cast("long")

    found = found.withColumns(
        {
            "marks_per_mille": ratio(F.col("_bw_marks"), F.col("word_chars"), 1000),
            "capitals_per_mille": ratio(F.col("_bw_capitals"), F.col("word_chars"), 1000),
            "dup_lines_per_mille": ratio(F.col("n_dup_lines"), F.col("_bw_n_lines"), 1000),
            "repeats_per_mille": ratio(F.col("n_repeat_words"), F.col("n_words"), 1000),
            LENGTH: ratio(F.col("word_chars"), F.col("n_words"), 100),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    ).drop("_bw_marks", "_bw_capitals", "_bw_n_lines")
    return found if keep_text else found.drop(text_col)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *METRICS, "base_failed", "kept", "failed_rules")


def sketches(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, metric, bucket, n): the histogram of each metric over the documents that pass the base rules."""
    each = counted.where(~F.col("base_failed")).select(
        F.coalesce(lang_col, F.lit("")).alias("lang"),
        F.coalesce(source_col, F.lit("")).alias("source"),
        F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))),
    ).where((F.col("value") > 0) | ~F.col("metric").isin(*NO_ZEROS))
    dropped = F.greatest(F.length(F.bin("value")) - 6, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(value, shift), shift)")
    return each.withColumn("shift", dropped).withColumn("bucket", bucket).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches added up to coarser groups."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per group a row with the number of documents and the quartiles of each metric; NULL where no document has the metric."""
    # the histogram of a group and metric has at most 32 buckets for each power of two
    points = sketch.groupBy(*keys, "metric").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("points"))

    def at(quarter: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(None).cast("long").alias("value"))
        step = lambda acc, p: F.struct(
            (acc["held"] + p["n"]).alias("held"),
            F.coalesce(acc["value"], F.when((acc["held"] + p["n"]) * 4 >= F.col("total") * quarter, p["bucket"])).alias("value"),
        )
        return F.aggregate("points", start, step)["value"]

    found = points.select(*keys, "metric", F.col("total").alias("n"), *(at(i).alias(f"q{25 * i}") for i in (1, 2, 3)))
    picked = [F.max(F.when(F.col("metric") == m, F.col(q))).alias(f"{m}_{q}") for m in METRICS for q in ("n", "q25", "q50", "q75")]
    return found.groupBy(*keys).agg(*picked)


def thresholds(sketch: DataFrame, prior: int = 100, reach: int = 12) -> DataFrame:
    """(_bw_lang, _bw_source) with the fences of each metric: see the module."""
    below = {m: F.col(f"{m}_q50") - F.col(f"{m}_q25") for m in METRICS}
    below[LENGTH] = F.least(below[LENGTH], F.col(f"{LENGTH}_q75") - F.col(f"{LENGTH}_q50"))
    own = quartiles(sketch, "lang", "source").withColumns({f"{m}_width": width for m, width in below.items()})
    own = written(own, "quality-quartiles")
    half = lambda c, tag: F.percentile(c, F.lit(0.5)).alias(tag)
    of_lang = own.groupBy("lang").agg(*(half(f"{m}_{c}", f"{m}_lang_{c}") for m in METRICS for c in ("q50", "width")))
    joined = own.join(of_lang, "lang")
    apart = joined.groupBy("lang").agg(*(half(F.abs(F.col(f"{m}_q50") - F.col(f"{m}_lang_q50")), f"{m}_apart") for m in METRICS))
    joined = joined.join(apart, "lang").crossJoin(F.broadcast(own.agg(*(half(f"{m}_width", f"{m}_all") for m in METRICS))))  # one row

    def fences(m: str) -> tuple[Column, Column]:
        held = F.coalesce(F.col(f"{m}_n"), F.lit(0))
        middle, usual, all_ = F.col(f"{m}_lang_q50"), F.col(f"{m}_lang_width"), F.nullif(F.col(f"{m}_all"), F.lit(0.0))
        leaning = lambda x, to: (held * F.coalesce(x, to) + prior * to) / (held + prior)
        spread = F.coalesce(F.nullif(F.greatest(leaning(F.col(f"{m}_width"), usual), usual), F.lit(0.0)), all_)
        far = (2 * reach if m in NO_ZEROS else reach) * spread
        furthest = 2 * (2 * reach if m in NO_ZEROS else reach) * (F.coalesce(F.nullif(usual, F.lit(0.0)), all_) + F.col(f"{m}_apart"))
        centre = leaning(F.col(f"{m}_q50"), middle)
        return F.greatest(centre - far, middle - furthest), F.least(centre + far, middle + furthest)

    found = [fences(m)[1].alias(f"most_{m}") for m in METRICS] + [fences(LENGTH)[0].alias(f"least_{LENGTH}")]
    return joined.select(F.col("lang").alias("_bw_lang"), F.col("source").alias("_bw_source"), *found)


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True, prior: int = 100, reach: int = 12) -> DataFrame:
    """``docs`` with the counts, the metrics, base_failed, kept and failed_rules (``base`` or names of metrics)."""
    counted = written(document_counts(docs, text_col, keep_text), "quality-counts")
    limits = written(thresholds(sketches(counted, lang_col, source_col), prior, reach), "quality-limits")
    marked = counted.withColumns({"_bw_lang": F.coalesce(lang_col, F.lit("")), "_bw_source": F.coalesce(source_col, F.lit(""))})
    if limits.count() <= BROADCAST_GROUPS:
        joined = marked.join(F.broadcast(limits), ["_bw_lang", "_bw_source"], "left")
    else:
        limits = limits.withColumn("_bw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = marked.withColumn("_bw_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(limits, ["_bw_lang", "_bw_source", "_bw_salt"], "left")
    out = {m: F.col(m) > F.col(f"most_{m}") for m in METRICS}
    out[LENGTH] = out[LENGTH] | (F.col(LENGTH) < F.col(f"least_{LENGTH}"))
    failed = F.array_compact(F.array(F.when(F.col("base_failed"), "base"), *(F.when(~F.col("base_failed") & wrong, m) for m, wrong in out.items())))
    return joined.withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0).select(*counted.columns, "kept", "failed_rules")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The documents that pass, with their own columns whatever their names."""
    held = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    return judge(held, keep_text=False, **options).where("kept").select("doc.*")
