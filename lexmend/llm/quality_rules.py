"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Every rule names a ratio of the features below and the closed range in which it passes. The
ratios of a text without words are null and pass; such a text fails the base rule instead.

Defined cases: a null text has no words. Repeated rows are judged alike. Empty tables give empty
results, and columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmend.llm.common import BREAKS, as_text, words

SYMBOLS = "#*$%&|<>"
EDGES = ".,;:!?\"'()[]-"
WINDOW = 8

#: Function words of the languages the rules are meant for.
STOP_WORDS = (
    "the of and to in a is it that for was on are as with he be at by this not or an from "
    "der die das und in den von zu mit ist im des auf für nicht ein eine sich dem auch "
    "le la les de des et en un une du que est pour dans il au par sur ne pas "
    "el los las del y que se por con para una su al lo como más pero sus no"
)


@dataclass(frozen=True)
class Rule:
    name: str
    value: str
    least: float | None = None
    most: float | None = None

    def passes(self) -> Column:
        x = F.expr(self.value)
        ok = F.lit(True)
        if self.least is not None:
            ok = ok & (x >= F.lit(self.least))
        if self.most is not None:
            ok = ok & (x <= F.lit(self.most))
        return F.coalesce(ok, F.lit(True))


#: name, ratio over the features, least, most.
RULES = (
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", 1.5, 20.0),
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", None, 0.3),
    Rule("repeated_lines", "n_dup_lines / nullif(n_lines, 0)", None, 0.4),
    Rule("stop_words", "n_stop_words / nullif(n_words, 0)", 0.01, None),
)


def _repeated(n: Column, hashes: Column) -> Column:
    """Words inside windows whose hash occurs more than once, given the hash of every window."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(hit, lambda j: F.get(s, j)["i"]))

    def covered(p: Column) -> Column:
        # Each start covers up to the next one, or a whole window.
        step = lambda j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(WINDOW)))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, j: a + step(j))

    bound = F.transform(F.array(ranked), starts)
    total = F.get(F.transform(bound, covered), F.lit(0))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)


def quality_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words."""
    text = F.col("_text")
    stop = sorted(set(STOP_WORDS.split()))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " " + BREAKS, "")) > 0)
    # A column inside a lambda may be inlined and run for each element; bound as an argument it runs once.
    each = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))
    windows = F.when(F.size("_words") >= WINDOW, F.get(F.transform(F.array(F.transform("_words", lambda w: F.xxhash64(w))), each), F.lit(0)))
    return (
        df.select(F.col(id_col).alias("_id"), as_text(F.col(text_col)).alias("_text"))
        .withColumn("_words", words(text))
        .withColumn("_lines", lines)
        .withColumn("_windows", windows)
        .select(
            F.col("_id").alias(id_col),
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.translate(text, " " + BREAKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(_repeated(F.size("_words"), F.col("_windows")), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.size(F.filter("_words", lambda w: F.btrim(F.lower(w), F.lit(EDGES)).isin(stop))).cast("long").alias("n_stop_words"),
        )
    )


def quality_verdict(features: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 20, most_repeated_percent: int = 30) -> DataFrame:
    """Adds base_failed, failed_rules (names in table order) and kept."""
    base = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated_percent)
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    return features.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return quality_verdict(quality_features(df, id_col, text_col), rules)
