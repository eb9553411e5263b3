"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a random but repeatable key.  Within a source the rows are dealt into equal ranges of
keys, the ranges' word counts are summed up from the lowest range on, and only the one range in
which the source's budget ends is sorted, to find the key at which the words reach the budget.
Whether a row is taken then follows from its own key, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import stage, word_count

ROWS_PER_RANGE = 65_536
ADDED = ("size", "source_size", "target", "taken")


def mix_key(seed: int) -> Column:
    """Depends on the document alone: reruns and retries agree."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Sources in code point order, null last, weigh `weights`, repeating.  They share `share` times
    all words by weight; a target stops at `limit` times its source's words and the excess is
    reshared by weight until none is above.  That end state is found directly: sources fill up in
    the order of limit / weight, so the running sums in that order give the level of the rest after
    each source that is full, and the first level which the next source can bear is the one.
    One row per source passes through here, no document does.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("w", F.element_at(pick, ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("top", F.col("source_size") * limit)
    filling = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(whole) * share).withColumn("weight", F.sum("w").over(whole))
        .withColumn("full", F.coalesce(F.sum("top").over(before), F.lit(0)))
        .withColumn("full_w", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("nth", F.row_number().over(filling))
        .withColumn("level", (F.col("total") - F.col("full")) / (F.col("weight") - F.col("full_w")))
        .withColumn("ok", F.col("top") >= F.col("w") * F.col("level"))
    )
    first = F.min(F.when(F.col("ok"), F.struct("nth", "level"))).over(whole)
    s = s.withColumn("first", first)
    target = F.when(F.col("nth") >= F.col("first.nth"), F.col("w") * F.col("first.level"))
    return s.select("source", "source_size", F.coalesce(target, F.col("top")).cast("double").alias("target"))


def cuts(rows: DataFrame, seed: int, **options) -> DataFrame:
    """One row per source: its words, target, whole epochs, and where the last epoch ends.

    `rows` has source, size, mix_key.  The last epoch takes every key under `cut`, `part` of the
    `cut_size` words at the cut, and nothing above.
    """
    n = rows.count()
    bits = max(4, min(40, (n // ROWS_PER_RANGE).bit_length()))
    # keys are signed: shifting out all but the top bits orders the ranges as the keys themselves
    ranged = rows.withColumn("range", F.shiftright("mix_key", 64 - bits))
    by_range = stage(ranged.groupBy("source", "range").agg(F.sum("size").alias("words")))
    sized = by_range.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sized, **options)
    budget = F.round("target").cast("long")
    goal = (
        goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    )
    goal = stage(goal)
    up = Window.partitionBy("source").orderBy("range")
    sums = by_range.withColumn("sum", F.sum("words").over(up)).withColumnRenamed("source", "of")
    at_range = (
        sums.join(goal, sums["of"].eqNullSafe(goal["source"]))
        .where("rest > 0 and sum >= rest and sum - words < rest")
        .select("of", F.col("range").alias("cut_range"), (F.col("rest") - F.col("sum") + F.col("words")).alias("left"))
    )
    at_range = stage(at_range)
    inside = ranged.join(at_range, ranged["source"].eqNullSafe(at_range["of"]) & (F.col("range") == F.col("cut_range")))
    keyed = inside.groupBy("of", "left", "mix_key").agg(F.sum("size").alias("cut_size"))
    keyed = keyed.withColumn("sum", F.sum("cut_size").over(Window.partitionBy("of").orderBy("mix_key")))
    at_key = keyed.where("sum >= left and sum - cut_size < left").select(
        "of", F.col("mix_key").alias("cut"), (F.col("left") - F.col("sum") + F.col("cut_size")).alias("part"), "cut_size"
    )
    return stage(goal.join(at_key, goal["source"].eqNullSafe(at_key["of"]), "left").drop("of"))


def narrow(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_key(seed).alias("mix_key"))


def mix(docs: DataFrame, seed: int = 11, keep_text: bool = False, prefix: str = "", **options) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    `docs` needs doc_id, text, source.  With `keep_text` all columns of `docs` come along.  The new
    columns' names start with `prefix`; a column of `docs` with such a name is replaced.

    A source takes whole epochs of its documents and, of one more epoch, documents in key order up
    to its budget, its target to the nearest word; of the document at the cut only the first words.
    Null texts have size 0 and take nothing; a null source is a source; null ids are kept.  Rows
    that repeat a document wholly share one key: at the cut they share the words left, rounded down
    each.  Sources without a word have the target 0.  No rows give no rows.
    """
    rows = stage(narrow(docs, seed))
    limits = cuts(rows, seed, **options)
    added = [prefix + c for c in ADDED]
    if keep_text:
        kept = [c for c in docs.columns if c not in added]
        rows = docs.select(*[F.col(f"`{c}`") for c in kept], word_count(F.col("text")).alias("_mix_size"), mix_key(seed).alias("_mix_key"))
    else:
        kept = ["doc_id", "source"]
        rows = rows.select(*kept, F.col("size").alias("_mix_size"), F.col("mix_key").alias("_mix_key"))
    limits = limits.select(*[F.col(c).alias(f"_mix_{c}") for c in limits.columns if c != "source"], F.col("source").alias("_mix_of"))
    last = (
        F.when(F.col("_mix_key") < F.col("_mix_cut"), F.col("_mix_size"))
        .when(F.col("_mix_key") == F.col("_mix_cut"),
              F.expr("cast(cast(_mix_part as decimal(38,0)) * _mix_size / _mix_cut_size as bigint)"))
        .otherwise(0)
    )
    joined = rows.join(limits, rows["source"].eqNullSafe(limits["_mix_of"]))
    taken = (F.col("_mix_epochs") * F.col("_mix_size") + last).cast("long")
    values = (F.col("_mix_size"), F.col("_mix_source_size"), F.col("_mix_target"), taken)
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(name) for v, name in zip(values, added, strict=True)])


def repeat(mixed: DataFrame, prefix: str = "") -> DataFrame:
    """The documents that `mix` with `keep_text` takes: one row per epoch, the last cut to the words it takes.

    A cut text ends with its last word taken; n_chars, where there is such a column, follows it.
    """
    size, taken = F.col(f"{prefix}size"), F.col(f"{prefix}taken")
    last = F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))
    rows = mixed.where(taken > 0).withColumn("_mix_epoch", F.explode(last))
    rows = rows.withColumn("_mix_left", F.least(size, taken - (F.col("_mix_epoch") - 1) * size))
    cut = F.col("_mix_left") < size
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, 1, F.col("_mix_left").cast("int")), "")
    rows = rows.withColumn("_mix_cut", cut).withColumn("text", F.when(F.col("_mix_cut"), head).otherwise(F.col("text")))
    if "n_chars" in rows.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_mix_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.drop("_mix_epoch", "_mix_left", "_mix_cut")
