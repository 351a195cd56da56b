"""Mixing sources to target weights by Pareto order sampling.

A source's target number of words is shared out by weight and never exceeds ``max_repeat`` times
what the source has; the excess goes to the others by weight. That is water filling: every source
below its cap gets the same number of words for each unit of weight.

The whole part of a source's target over its size is certain: every document has that many
copies. The rest f of it is shared out as inclusion probabilities that differ by document:
p = f + (x - m) * min(f, 1 - f), where x in [0, 1] is the document's preference and m the mean
preference of the source's words. So p lies between 0 and 1, and the expected number of words is
the target. By default x = ``HALF`` / (``HALF`` + bytes of the text): a source's remainder goes to its
shorter documents rather than to a few long ones. ``prefer_col`` names another x.

Documents are ranked by the random odds u/(1-u) over the inclusion odds p/(1-p), with u from a
hash of id and text, and the sample takes, in the order of the ranks, each document that fits the
words that are left. So it has a fixed size in words: at its end no document of the source that
could still be drawn fits. Rows that repeat id and text have the same u and are told apart by a
row key, so some of them can be in the sample and others not.

The cut of a source is found without sorting it: words are summed over 1,024 ranges of the rank,
then over 1,024 parts of the range that holds the cut, and only the part that holds it is ordered.
A source with a third of all rows thus never meets in one task. Behind the cut only documents
that are smaller than the gap matter; the best ranked of them (``REACH`` times the words of the gap, about
``MOST`` rows of a source at a time) are gone through one by one, until nothing fits. What is joined to the documents
is a table with one row for each source and one of the few documents that closed gaps, so no text
is shuffled.

Defined cases: a null text has no words. A null source is one source, the last. A null id counts as
the empty text in u and ranks ahead of others in a tie. Any text is counted whole, however long. A
document without words is taken whole times only. Empty tables give empty results. Other columns,
of any name, are neither read nor changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmend.llm.common import WORD, as_text, drop_staged, n_words, row_keyed, staged

STEP = 1024
DIGITS = 13  # hexadecimal digits of the hash that make up u: 52 bits, exact in a double
#: Bytes of a text whose preference is one half, and the steps in which preferences are counted (sums stay whole numbers).
HALF, SCALE = 512, 1024
#: Probabilities keep this distance from 0 and 1, so that their odds are finite.
EDGE = 1e-9
#: How far behind the cut one pass looks for documents that close the gap: words, in gaps, and rows.
REACH, MOST = 64, 10_000


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of id and text, the same on every run."""
    body = F.concat(as_text(id_col), F.lit("/"), F.md5(as_text(text).cast("binary")), F.lit(f"/{seed}"))
    return (F.conv(F.substring(F.md5(body.cast("binary")), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def source_targets(sizes: DataFrame, max_repeat: int = 3, cycle: int = 3) -> DataFrame:
    """``sizes`` (source, source_size and others), the catalogue of sources, one row for each, with the target of each.

    Sources in order of code points, null last, weigh 1 to ``cycle``, repeating.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.pmod(F.row_number().over(every) - 1, F.lit(cycle)).cast("double") + 1)
    capped = weighed.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    # Sources fill up in the order of cap over weight; the level is that of the first that doesn't.
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # What is left for this source and those after it, over their weights, which are whole numbers: a frame up to the end would be summed up for every row.
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(whole).cast("double") - ahead("cap")) / (F.sum("weight").over(whole) - ahead("weight"))
    filled = capped.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("fill"), F.col("level").alias("level")))).over(whole)["level"]
    return filled.select(*sizes.columns, F.least(F.col("cap"), water * F.col("weight")).alias("target"))


def _found(words: DataFrame, range_col: str) -> DataFrame:
    """The range of each source in which its running sum of words and those ahead reaches what is left to take: source, range, left, before. ``words`` has source, range, words, left, ahead."""
    run = Window.partitionBy("source").orderBy(range_col)
    return (
        words.withColumn("upto", F.sum("words").over(run))
        .filter((F.col("upto") + F.col("ahead") >= F.col("left")) & (F.col("upto") + F.col("ahead") - F.col("words") < F.col("left")))
        .select("source", range_col, "left", (F.col("upto") + F.col("ahead") - F.col("words")).alias("before"))
    )


def _scored(rows: DataFrame, targets: DataFrame, max_repeat: int) -> DataFrame:
    """``rows`` (id, source, u, x, some, key) with their source's row of ``targets``, certain copies and rank."""
    words = F.greatest(F.col("source_size"), F.lit(1))  # a source without words has the target 0
    p = F.col("f") + (F.col("x") - F.col("pull") / words) / float(SCALE) * F.least(F.col("f"), 1 - F.col("f"))
    return (
        rows.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("e", F.least(F.col("target") / words, F.lit(float(max_repeat))))
        .withColumn("whole", F.floor("e"))
        .withColumn("f", F.col("e") - F.col("whole"))
        .withColumn("p", F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p)))
        .withColumn("q", F.when((F.col("f") > 0) & F.col("some"), (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("fine", F.floor(F.col("q") / (1 + F.col("q")) * (STEP * STEP)))
    )


def _rank() -> Column:
    return F.struct("q", F.col("id").isNotNull().alias("known"), "id", "key")


def _ahead_of_cut() -> Column:
    """Whether a scored row that is joined to its source's cut ranks up to it."""
    at_cut = F.coalesce(_rank() <= F.col("cut"), F.lit(False))
    return (
        F.when(F.col("q").isNull() | (F.col("left") <= 0), F.lit(False))
        # A source without a cut has less than what is left in all of its rows.
        .when(F.col("cut_range").isNull(), F.lit(True))
        .otherwise((F.col("fine") < F.col("cut_range")) | ((F.col("fine") == F.col("cut_range")) & at_cut))
    )


def _copied(rows: DataFrame, cuts: DataFrame, closing: DataFrame, max_repeat: int) -> DataFrame:
    """``rows`` scored, with ``copies``."""
    more = _scored(rows, cuts, max_repeat).join(closing.withColumnRenamed("key", "closing"), F.col("key") == F.col("closing"), "left")
    return more.withColumn("copies", (F.col("whole") + (_ahead_of_cut() | F.col("closing").isNotNull()).cast("long")).cast("long"))


def _rows(df: DataFrame, id_col: str, text_col: str, source_col: str, prefer_col: str | None, key_col: str, seed: int, *more: Column) -> DataFrame:
    if prefer_col:
        x = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(prefer_col).cast("double"), F.lit(0.5)))) * SCALE)
    else:
        x = F.floor(F.lit(float(SCALE * HALF)) / (HALF + F.octet_length(as_text(F.col(text_col)))))
    return df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), uniform(F.col(id_col), F.col(text_col), seed).alias("u"), x.cast("long").alias("x"), F.col(key_col).alias("key"), *more)


def _first_cut(scored: DataFrame) -> DataFrame:
    """Where the sample of a source first meets a document that doesn't fit: x_source, cut_range, cut (the last rank that fits), done (words up to it)."""
    drawn, words = scored.filter("q is not null"), F.sum("size").alias("words")
    # What is left of a source goes along with its rows: a join for it would be one more broadcast table in the driver.
    coarse = staged(_found(drawn.groupBy("source", "coarse").agg(words, F.first("left").alias("left")).withColumn("ahead", F.lit(0).cast("long")), "coarse"), "mix-coarse")
    inside = drawn.join(coarse.select(F.col("source").alias("c_source"), F.col("coarse").alias("c_coarse"), F.col("before").alias("ahead")), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("coarse") == F.col("c_coarse")))
    fine = staged(_found(inside.groupBy("source", "fine").agg(words, F.first("left").alias("left"), F.first("ahead").alias("ahead")), "fine"), "mix-fine")
    fine = fine.select(F.col("source").alias("k_source"), F.col("fine").alias("cut_range"), F.col("left").alias("k_left"), "before")
    part = drawn.join(fine, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("fine") == F.col("cut_range")))
    order = Window.partitionBy("source").orderBy("q", F.col("id").asc_nulls_first(), "key")
    # Where not even the first row of the part fits, there is no cut in it.
    fits = F.col("upto") <= F.col("k_left")
    cuts = (
        part.withColumn("upto", F.col("before") + F.sum("size").over(order))
        .groupBy(F.col("source").alias("x_source"))
        .agg(F.first("cut_range").alias("cut_range"), F.max(F.when(fits, _rank())).alias("cut"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.first("before")).alias("done"))
    )
    cuts = staged(cuts, "mix-first")
    for held in (coarse, fine):
        drop_staged(held)
    return cuts


def _nearest(rows: DataFrame, range_col: str) -> DataFrame:
    """The rows in the first ranges of each source: those with ``REACH`` gaps of words and ``MOST`` rows at most ahead of them."""
    run = Window.partitionBy("source").orderBy(range_col).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("source", range_col).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first(F.col("left") - F.col("done")).alias("gap"))
    ranges = ranges.withColumn("words", F.coalesce(F.sum("words").over(run), F.lit(0))).withColumn("n", F.coalesce(F.sum("n").over(run), F.lit(0)))
    ranges = ranges.filter((F.col("words") <= REACH * F.col("gap")) & (F.col("n") <= MOST)).select(F.col("source").alias("r_source"), F.col(range_col).alias("r_range"))
    return rows.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col(range_col) == F.col("r_range"))).drop("r_source", "r_range")


def _closing(scored: DataFrame, first: DataFrame) -> DataFrame:
    """The keys of the documents behind the cuts that fit what is left, gone through in the order of their ranks."""
    fits = F.col("size") + F.col("done") <= F.col("left")
    columns = ("source", "q", "id", "key", "size", "fine", "coarse", "left", "done")
    behind = scored.filter("q is not null").join(first, F.col("source").eqNullSafe(F.col("x_source"))).filter(~_ahead_of_cut() & fits)
    open_ = staged(behind.select(*columns), "mix-open")
    found = [open_.sparkSession.range(0).select(F.col("id").alias("key"))]
    while not open_.isEmpty():
        near = _nearest(_nearest(open_, "coarse"), "fine")
        # A few ranges of each source, at most about ``MOST`` rows of it.
        queue = near.groupBy("source").agg(F.first("left").alias("left"), F.first("done").alias("done"), F.max("fine").alias("last"), F.array_sort(F.collect_list(F.struct("q", F.col("id").isNotNull().alias("known"), "id", "key", "size"))).alias("queue"))

        def step(acc: Column, x: Column) -> Column:
            fits = acc["done"] + x["size"] <= acc["left"]
            return F.when(fits, F.struct(acc["left"].alias("left"), (acc["done"] + x["size"]).alias("done"), F.concat(acc["keys"], F.array(x["key"])).alias("keys"))).otherwise(acc)

        start = F.struct("left", "done", F.array().cast("array<bigint>").alias("keys"))
        passed = staged(queue.select("source", "last", F.aggregate("queue", start, step).alias("acc")), "mix-passed")
        found.append(passed.select(F.explode("acc.keys").alias("key")))
        state = passed.select(F.col("source").alias("p_source"), "last", F.col("acc.done").alias("now"))
        rest = open_.join(state, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("fine") > F.col("last"))).withColumn("done", F.col("now"))
        was, open_ = open_, staged(rest.filter(fits).select(*columns), "mix-open")
        drop_staged(was)
    keys = staged(reduce(DataFrame.union, found), "mix-closing")
    for held in (open_, *found[1:]):
        drop_staged(held)
    return keys


def _plan(df: DataFrame, id_col: str, text_col: str, source_col: str, prefer_col: str | None, key_col: str, max_repeat: int, cycle: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows without texts, a row for each source with its target and cut, and the keys of the documents that close gaps."""
    size = n_words(F.col(text_col))
    base = staged(_rows(df, id_col, text_col, source_col, prefer_col, key_col, seed, size.alias("size")).withColumn("some", F.col("size") > 0), "mix-base")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("x")).alias("pull"))
    # The certain copies of a source follow from its size.
    sure = F.floor(F.least(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(float(max_repeat)))) * F.col("source_size")
    targets = staged(source_targets(sizes, max_repeat, cycle).withColumnRenamed("source", "t_source").withColumn("left", F.col("target") - sure), "mix-targets")
    # Written once: else every plan below would hold the join with the targets and the formula of the rank, several times over.
    scored = _scored(base, targets, max_repeat).withColumn("coarse", F.floor(F.col("fine") / STEP))
    scored = staged(scored.select("source", "id", "key", "size", "q", "fine", "coarse", "left"), "mix-scored")
    first = _first_cut(scored)
    cuts = targets.join(first, F.col("t_source").eqNullSafe(F.col("x_source")), "left")
    cuts = staged(cuts.select("t_source", "source_size", "target", "pull", "left", "cut_range", "cut", "done"), "mix-cuts")
    closing = _closing(scored, first)
    for held in (targets, scored, first):
        drop_staged(held)
    return base, cuts, closing


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prefer_col: str | None = None, max_repeat: int = 3, cycle: int = 3, seed: int = 7) -> DataFrame:
    """One row for each row of ``df``: id, source, size, source_size, target, copies, taken."""
    keyed, key = row_keyed(df)
    base, cuts, closing = _plan(keyed, id_col, text_col, source_col, prefer_col, key, max_repeat, cycle, seed)
    made = _copied(base, cuts, closing, max_repeat)
    return made.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prefer_col: str | None = None, max_repeat: int = 3, cycle: int = 3, seed: int = 7) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the plan says."""
    keyed, _ = row_keyed(df)
    names = [f"_c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    flat = keyed.toDF(*names, "_key")
    own = (at[id_col], at[text_col], at[source_col], at.get(prefer_col), "_key")
    base, cuts, closing = _plan(flat, *own, max_repeat, cycle, seed)
    drop_staged(base)
    some = as_text(F.col(at[text_col])).rlike(WORD).alias("some")
    rows = _rows(flat, *own, seed, some, *[F.col(n) for n in names])
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return _copied(rows, cuts, closing, max_repeat).filter("copies > 0").withColumn("copy", each).select(*[F.col(n).alias(c) for c, n in at.items()])
