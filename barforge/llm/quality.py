"""Quality rules with adaptive thresholds.

Base rules are fixed. The method's verdict comes from thresholds that follow the corpus: for every language and
source a mergeable quantile sketch (counts on a fixed grid: merging is adding, the answer does not depend on the order
of merging, the error is at most one cell: a thousandth for shares, a hundredth of the value for the mean word length) gives the median, the upper quartile and the tenth and ninetieth percentile of
each metric; sketches of sources are merged to one per language and to one of all, which stand in for groups with few
documents. A document goes when a metric lies beyond its group's fence, which is drawn from the part of the
distribution that junk does not reach, plus a minimum spread, so that a group without outliers loses nothing: for the
mean word length the half on the other side of the median, for shares, whose median is often zero, the upper quartile as
well. What a quarter of a group's documents or more carry is thus the group's own habit, not an outlier.

Defined results: a null text has no words (and fails the base rules); null language or source is a group of its own;
equal rows get equal verdicts; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import let, materialize, maybe_broadcast, packed, text_of, unpacked, words_of

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Columns that quality_features() adds.
FEATURES = ("word_chars", "n_symbols", "n_words", "n_repeat_words", "n_dup_lines", "n_lines", "base_failed")
#: Code points of SPACE, for translate().
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Metric:
    """A metric on an integer grid. ``spread``: least distance from the median to a fence, in grid steps."""

    name: str
    spread: int
    two_sided: bool = False


#: In thousandths, but for the mean word length in hundredths of a character.
METRICS = (Metric("symbols", 30), Metric("word_length", 150, True), Metric("repeats", 300), Metric("dup_lines", 600))

def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            ordered,
            lambda s: F.filter(
                s,
                lambda e, k: F.coalesce(e["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, k + 1)["h"], F.lit(False)),
            ),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    many = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) < 3, 0).otherwise(many)


def quality_features(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed."""
    text = text_of()
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    counts = let(words_of(text), lambda w: F.struct(F.size(w).alias("words"), _repeat_words(w).alias("repeats")))
    out = docs.withColumns(
        {
            "_counts": counts,
            "_lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        }
    ).withColumns(
        {
            "n_words": F.col("_counts.words").cast("long"),
            "n_repeat_words": F.col("_counts.repeats").cast("long"),
            "n_dup_lines": F.col("_lines.dup").cast("long"),
            "n_lines": F.col("_lines.n").cast("long"),
        }
    )
    return out.drop("_counts", "_lines").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def three_digits(value: Column) -> Column:
    """``value`` cut to its first three digits: a grid without an end, whose cells grow with the value."""
    step = F.lit(1)
    for k in range(3, 19):
        step = F.when(value >= 10**k, 10 ** (k - 2)).otherwise(step)
    return value - value % step


def _cells() -> dict[str, Column]:
    part = lambda a, b, scale: F.expr(f"{a} * {scale} div greatest({b}, 1)")
    return {
        "symbols": part("n_symbols", "word_chars", 1000),
        "word_length": three_digits(part("word_chars", "n_words", 100)),
        "repeats": part("n_repeat_words", "n_words", 1000),
        "dup_lines": part("n_dup_lines", "n_lines", 1000),
    }


def quantile_sketches(features: DataFrame) -> DataFrame:
    """(lang, source, metric, cell, n) of the documents that pass the base rules: one mergeable sketch per language and source."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("long").alias("cell")) for k, v in _cells().items()))).alias("m")
    rows = features.where(~F.col("base_failed")).select("lang", "source", each)
    return rows.groupBy("lang", "source", F.col("m.metric").alias("metric"), F.col("m.cell").alias("cell")).agg(F.count("*").alias("n"))


def adaptive_fences(sketches: DataFrame, least_docs: int = 200) -> DataFrame:
    """(lang, source, low, high): a map from metric to fence for each group, from the finest level with ``least_docs`` documents."""
    null = F.lit(None).cast("string")
    level = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"))
    levels = F.explode(F.array(level(2, F.col("lang"), F.col("source")), level(1, F.col("lang"), null), level(0, null, null)))
    merged = (
        sketches.select(levels.alias("g"), "metric", "cell", "n").groupBy("g.level", "g.lang", "g.source", "metric", "cell").agg(F.sum("n").alias("n"))
    )
    whole = Window.partitionBy("level", "lang", "source", "metric")
    so_far = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("all"), F.col("cell")))
    marks = (
        merged.withColumns({"upto": F.sum("n").over(so_far), "all": F.sum("n").over(whole)})
        .groupBy("level", "lang", "source", "metric")
        .agg(at(10).alias("p10"), at(50).alias("p50"), at(75).alias("p75"), at(90).alias("p90"), F.max("all").alias("docs"))
    )
    spread = F.create_map(*(x for m in METRICS for x in (F.lit(m.name), F.lit(m.spread))))[F.col("metric")]
    two_sided = F.col("metric").isin([m.name for m in METRICS if m.two_sided])
    below, above = F.col("p50") + 4 * (F.col("p50") - F.col("p10")), F.col("p75") + 4 * (F.col("p75") - F.col("p50"))
    high = F.when(two_sided, below).otherwise(F.greatest(below, above)) + spread
    low = F.when(two_sided, F.col("p50") - 4 * (F.col("p90") - F.col("p50")) - spread).otherwise(F.lit(-1))
    fences = marks.select("level", "lang", "source", "docs", F.struct("metric", low.alias("low"), high.alias("high")).alias("fence"))
    fences = fences.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), F.collect_list("fence").alias("fences"))  # one for each metric
    groups, of = sketches.select("lang", "source").distinct(), lambda k: fences.where(F.col("level") == k)
    fine = of(2).select(F.col("lang").alias("l2"), F.col("source").alias("s2"), F.col("docs").alias("d2"), F.col("fences").alias("f2"))
    mid = of(1).select(F.col("lang").alias("l1"), F.col("docs").alias("d1"), F.col("fences").alias("f1"))
    rest = of(0).select(F.col("fences").alias("f0"))
    joined = (
        groups.join(fine, F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2")), "left")
        .join(mid, F.col("lang").eqNullSafe(F.col("l1")), "left")
        .join(F.broadcast(rest), F.lit(True), "left")  # a single row
    )
    chosen = F.when(F.col("d2") >= least_docs, F.col("f2")).when(F.col("d1") >= least_docs, F.col("f1")).otherwise(F.col("f0"))
    return joined.select("lang", "source", chosen.alias("fences"))


def quality_filter(features: DataFrame, least_docs: int = 200) -> DataFrame:
    """``features`` (of quality_features) with boolean ``kept``. Reads its input three times: give it a materialized one."""
    fences = maybe_broadcast(materialize(adaptive_fences(materialize(quantile_sketches(features), "sketches"), least_docs), "fences"), 100_000)
    fences = fences.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("fences").alias("_fences"))
    joined = features.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    values = F.create_map(*(x for k, v in _cells().items() for x in (F.lit(k), v.cast("long"))))
    inside = F.forall(F.coalesce(F.col("_fences"), F.array()), lambda f: F.element_at(values, f["metric"]).between(f["low"], f["high"]))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("_lang", "_source", "_fences")


def quality_rules(docs: DataFrame, least_docs: int = 200) -> DataFrame:
    """All columns of ``docs``, its features and ``kept``."""
    features = quality_features(packed(docs, "text", "lang", "source")).drop("text")
    return unpacked(quality_filter(materialize(features, "quality"), least_docs), docs.columns, *FEATURES, "kept")
