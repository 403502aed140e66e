"""Quality rules: a table of thresholds compiled into one projection.

Each rule names a measure of the text, the side and the limit. Measures and verdicts are Spark columns:
no user function, no shuffle.

Nulls: a null text has no words, so every measure is 0 and the length rule fails it. Repeated rows each
get a row; an empty table gives none. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.llm import common

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "it", "for", "with", "as", "on", "be", "by", "this",
    "de", "la", "le", "les", "des", "et", "un", "une", "en", "du", "que", "qui", "pour", "dans", "par",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "ist", "im", "dem", "nicht", "ein", "eine",
    "el", "los", "las", "y", "se", "del", "con", "para", "su", "al", "no", "es", "por", "lo", "una",
)
#: (rule, measure, side, limit): a document fails a rule if its measure is below ("min") or above ("max") the limit.
THRESHOLDS = (
    ("too_short", "n_words", "min", 20),
    ("too_long", "n_words", "max", 10_000_000),
    ("repeats", "repeat_ratio", "max", 0.3),
    ("symbols", "symbol_ratio", "max", 0.1),
    ("shouting", "shout_ratio", "max", 0.2),
    ("word_length", "mean_word_chars", "max", 30),
    ("stop_words", "stop_ratio", "min", 0.05),
    ("same_lines", "dup_line_ratio", "max", 0.5),
)
_BLANK = " \t\n\x0b\x0c\r"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where a lambda inside reads it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of `width` words that occur at least twice in the text."""
    n = F.size(words) - width + 1
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.slice(h, i + 1, width)))

    def covered(keys: Column) -> Column:
        pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return bound(pairs, lambda p: bound(places(p), lambda q: F.aggregate(q, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])))

    def places(p: Column) -> Column:
        """Sorted places of windows whose key has a neighbour of the same key."""
        marked = F.transform(p, lambda x, j: F.when((F.get(p, j - 1)["k"] == x["k"]) | (F.get(p, j + 1)["k"] == x["k"]), x["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    counted = bound(hashed, lambda h: bound(windows(h), lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(covered(keys))))
    return F.when(n < 2, F.lit(0)).otherwise(counted).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and every measure of the threshold table."""
    text = F.col("text")
    count = lambda chars: (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")
    split = docs.select(F.col(id_col).alias("doc_id"), common.whole_text(text_col).alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    # lines with a word; without one, nothing is left when blanks are removed
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, _BLANK, "") != "")
    split = split.withColumn("lines", lines)
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate(text, _BLANK, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count("!").alias("n_shouts"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stops"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "*",
        (F.col("n_repeat_words") / n).alias("repeat_ratio"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("n_shouts") / n).alias("shout_ratio"),
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_stops") / n).alias("stop_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
    )


def verdict(measured: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The measures with one boolean a rule, compiled from the table, and `kept`."""
    fails = {name: (F.col(m) < limit if side == "min" else F.col(m) > limit) for name, m, side, limit in thresholds}
    failed = F.lit(False)
    for f in fails.values():
        failed = failed | f
    return measured.select("*", *[f.alias(f"fails_{k}") for k, f in fails.items()], (~failed).alias("kept"))


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Measures, rules and verdict of every document."""
    return verdict(measures(docs), thresholds)
