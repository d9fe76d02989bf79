"""Operator 10 [native]: quality rules with adaptive thresholds for each language and source.

Measures of every whole text are taken once; mergeable KLL sketches of each (language, source) then give the
quantiles that set that group's limits, in place of fixed cut-offs, and the limits are joined back. Junk lies high, so a
limit is measured from the low side: FENCE spreads and a half above the 25 % quantile, where the spread is the smaller
of q75 - q25 and 3/2 of q25 - q05 (about as wide in a normal distribution), which junk in half of the rows cannot set. It
lies at least the measure's MARGIN above that quantile, so a group without spread does not lose clean documents. A group
of fewer than LEAST_ROWS documents takes the limits of its language, and a small language those of all documents.

Cases: a null or empty text has no words and fails the base rules; null languages and sources form groups like any
other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, salted

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW_WORDS = 20, 30, 8
#: Spreads above the middle that a measure may reach, and how far above its 25 % quantile it always may.
FENCE = 3.0
MARGINS = {"symbols_per_word": 0.5, "chars_per_word": 2.0, "dup_lines_per_line": 0.3}
#: Documents from which a group or language has limits of its own.
LEAST_ROWS = 50
#: Accuracy of the sketches: rank error of about 1.3 % (k = 200 is the library's default).
SKETCH_K = 200


def _repeat_words(words: Column) -> Column:
    """Words that lie in an 8-word window found at least twice; 0 at once where all windows differ."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (WINDOW_WORDS - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW_WORDS)))
    return F.when(n < WINDOW_WORDS, F.lit(None).cast("array<bigint>")).otherwise(hashes)


def _covered(windows: str) -> Column:
    """Words under repeated windows: starts of repeated windows in order, each adding the words the one before lacks."""
    at = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rest = F.size(windows) - 1
    equal = F.zip_with(F.slice(at, 1, rest), F.slice(at, 2, rest), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))
    zero = F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).cast("long").alias("sum"))
    add = F.aggregate(starts, zero, lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(WINDOW_WORDS), i - s["last"])).cast("long").alias("sum")))
    return add["sum"]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of each whole text; exact, in built-in functions."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), text.alias("text"))
    words = F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = base.select(
        "doc_id", "lang", "source",
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"), words.alias("words"),
    )
    step = step.withColumns({"n_words": F.size("words").cast("long"), "n_lines": F.size("lines").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "windows": _repeat_words(F.col("words"))})
    same = F.coalesce(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(True))
    return step.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(same, F.lit(0).cast("long")).otherwise(_covered("windows")).alias("n_repeat_words"))


def quality(docs: DataFrame) -> DataFrame:
    """The measures, base_failed, the group's limits, and kept."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    slim = measures(docs).withColumns({"symbols_per_word": F.col("n_symbols") / words, "chars_per_word": F.col("word_chars") / words, "dup_lines_per_line": F.col("n_dup_lines") / lines})
    slim = checkpoint(salted(slim, "doc_id").withColumns({"_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))}))
    group = ["_lang", "_source"]
    sketches = slim.rollup(*group).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, SKETCH_K).alias(m) for m in MARGINS])

    def limit(m: str) -> Column:
        least, low, high = (F.kll_sketch_get_quantile_double(m, F.lit(q)) for q in (0.05, 0.25, 0.75))
        spread = F.least(high - low, 1.5 * (low - least))
        return (low + F.greatest(F.lit(MARGINS[m]), F.lit(FENCE + 0.5) * spread)).alias(m)

    # a row for each group, and with nulls for each language and for all
    levels = checkpoint(sketches.select(*group, "n", *map(limit, MARGINS)))
    wide = lambda df, name: df.select("_lang", F.struct("n", *MARGINS).alias(name))
    langs, every = (wide(levels.where(f"_source is null and _lang is {x}null"), name) for x, name in (("not ", "of_lang"), ("", "of_all")))
    chosen = levels.where("_source is not null").join(langs, "_lang").crossJoin(F.broadcast(every.drop("_lang")))
    best = F.when(F.col("n") >= LEAST_ROWS, F.struct("n", *MARGINS)).when(F.col("of_lang.n") >= LEAST_ROWS, F.col("of_lang")).otherwise(F.col("of_all"))
    chosen = chosen.withColumn("best", best).select(*group, *[F.col(f"best.{m}").alias(f"max_{m}") for m in MARGINS])
    limits = slim.select(*group, "_salt").distinct().join(chosen, group)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    within = F.lit(True)
    for m in MARGINS:
        within = within & (F.col(m) <= F.col(f"max_{m}"))
    out = slim.join(limits, [*group, "_salt"]).withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"), *[f"max_{m}" for m in MARGINS])
