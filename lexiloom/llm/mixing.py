"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

The words of all sources are shared out again by weight. A source whose share exceeds ``epochs`` times its own
words is clamped there, and what it leaves goes to the others in proportion to their weights, until no share is
too large. A share is whole repetitions of all the source's documents, and a fraction of one more: documents
in the order of a seeded hash, up to the word at which the share is full. The document at that place gives its
first words only, so a source misses its target by a rounding.

Texts are read once and never move. Rows meet in no window but those of one of ``BUCKETS`` ranges of a source's
hashes, and the table of sources is joined with a salt, so no source is hot.

Defined results: null and empty texts have no words and are taken with none; null is a source of its own, after
all others; rows of equal id, text and source have one hash, and if the share ends in them they give equal parts,
so the source misses its target by up to half a word for each of them; a table without words has targets of
zero; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import stored, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
SPACE_SIGNS = " \t\n\x0b\f\r"
#: Ranges of a source's hashes; the one that holds the end of its share is ranked row by row.
BUCKETS = 1 << 14
KEY_BITS = 60
#: Copies of a source's row in the join with its documents.
SALTS = 32


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    inner = F.btrim(text, F.lit(SPACE_SIGNS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def measures(id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """(source, no_source, size, key): each row's words and its place in the seeded order of its source."""
    digest = F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col(id_col), text_col))
    return [
        text_or_empty(source_col).alias("source"),
        F.col(source_col).isNull().alias("no_source"),
        F.size(words_of(text_or_empty(text_col))).cast("bigint").alias("size"),
        F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint").alias("key"),
    ]


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(doc_id, source, no_source, size, key) of every row, stored: the texts are read here only."""
    return stored(df.select(F.col(id_col).alias("doc_id"), *measures(id_col, text_col, source_col, seed)), "sizes")


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, no_source, source_size, weight), the weights repeating over the sources in code point order.

    A source's number is its place in its sorted partition plus the rows of the partitions before.
    """
    totals = sizes.groupBy("source", "no_source").agg(F.sum("size").alias("source_size"))
    place = F.monotonically_increasing_id()
    placed = stored(totals.orderBy("no_source", "source").withColumn("place", place), "sources")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    # one row per sorted partition
    starts = starts.select("part", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("start"))
    number = F.col("start") + inside
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights)).cast("int") + 1)
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select(
        "source", "no_source", "source_size", weight.cast("bigint").alias("weight")
    )


def water_filled(sources: DataFrame, epochs: int) -> DataFrame:
    """Add (target, goal): the source's share of all words, and the share as a whole number of words.

    Each round clamps the sources above ``epochs`` times their words at the level that the sources clamped so
    far leave to the rest. The level only rises, so a clamped source stays clamped; the rounds end when no
    further one is. A round is one sum over the sources.
    """
    whole = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    total, weight = whole["words"] or 0, whole["weight"] or 0
    cap = F.col("source_size") * epochs
    words, free, held = total, weight, 0
    while True:
        wide = cap.cast("decimal(20,0)") * F.lit(free).cast("decimal(17,0)")
        above = wide < F.col("weight").cast("decimal(17,0)") * F.lit(words).cast("decimal(20,0)")
        round_ = sources.where(above).agg(F.count("*").alias("n"), F.sum(cap).alias("words"), F.sum("weight").alias("weight"))
        clamped = round_.first()
        if clamped["n"] == held:
            break
        words, free, held = total - clamped["words"], weight - clamped["weight"], clamped["n"]
    level = F.col("weight") * F.lit(words)
    share = level.cast("double") / F.lit(float(max(free, 1)))
    nearest = F.expr(f"(2 * weight * {words} + {free}) div {2 * max(free, 1)}")
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(share)).withColumn(
        "goal", F.when(above, cap).otherwise(nearest)
    )


def cuts(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """(source, no_source, cut_key, cut_words): where in each source's order its fraction of a repetition ends.

    Documents of smaller keys are in it whole, those of this key with ``cut_words`` each.
    """
    source = ["source", "no_source"]
    bucket = F.shiftright("key", KEY_BITS - (BUCKETS - 1).bit_length())
    keyed = sizes.where("size > 0").withColumn("bucket", bucket)
    ends = (F.col("before") < F.col("part_goal")) & (F.col("part_goal") <= F.col("before") + F.col("words"))

    def reached(table: DataFrame, goals: DataFrame, order: str) -> DataFrame:
        upto = F.sum("words").over(Window.partitionBy(*source).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        running = table.withColumn("before", F.coalesce(upto, F.lit(0)))
        return running.join(goals, source).where(ends)

    totals = keyed.groupBy(*source, "bucket").agg(F.sum("size").alias("words"))
    buckets = reached(totals, shares.where("part_goal > 0").select(*source, "part_goal"), "bucket")
    buckets = stored(buckets.select(*source, "bucket", (F.col("part_goal") - F.col("before")).alias("part_goal")), "cut-buckets")
    near = keyed.join(buckets.select(*source, "bucket"), [*source, "bucket"])
    ties = near.groupBy(*source, "key").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    found = reached(ties, buckets.select(*source, "part_goal"), "key")
    return found.select(
        *source,
        F.col("key").alias("cut_key"),
        F.expr("(2 * (part_goal - before) + rows) div (2 * rows)").alias("cut_words"),
    )


def shares_of(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """One row per source: its size, target, whole repetitions, and the end of its fraction of one more."""
    filled = stored(water_filled(weighted_sources(sizes, weights), epochs), "targets")
    repeats = F.expr("if(source_size > 0, goal div source_size, 0)")
    shares = filled.withColumn("repeats", repeats).withColumn(
        "part_goal", F.col("goal") - F.col("repeats") * F.col("source_size")
    )
    return stored(shares.join(cuts(sizes, shares), ["source", "no_source"], "left"), "shares")


def taken_from(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """Add the source's columns, and (part_words, taken): words of the fraction, and of the whole mix."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = sizes.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    joined = salted.join(shares.withColumn("salt", salt), ["source", "no_source", "salt"])
    part = (
        F.when(F.col("key") < F.col("cut_key"), F.col("size"))
        .when(F.col("key") == F.col("cut_key"), F.least("size", "cut_words"))
        .otherwise(F.lit(0).cast("bigint"))
    )
    return joined.withColumn("part_words", part).withColumn(
        "taken", F.col("repeats") * F.col("size") + F.col("part_words")
    )


def plan_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """(id, source, size, source_size, target, repeats, part_words, taken) for each row."""
    sizes = sized(df, id_col, text_col, source_col, seed)
    return taken_from(sizes, shares_of(sizes, weights, epochs)).select(
        F.col("doc_id").alias(id_col),
        F.when(~F.col("no_source"), F.col("source")).alias(source_col),
        "size",
        "source_size",
        "target",
        "repeats",
        "part_words",
        "taken",
    )


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """The mix itself: the columns of ``df``, once per repetition, where a part of a text is its first words."""
    shares = shares_of(sized(df, id_col, text_col, source_col, seed), weights, epochs)
    # the columns travel as one, so that their names cannot clash with inner ones
    packed = df.select(F.struct(*df.columns).alias("row"))
    rows = packed.select("row", *measures(f"row.{id_col}", f"row.{text_col}", f"row.{source_col}", seed))
    whole = F.array_repeat(F.lit(-1).cast("bigint"), F.col("repeats").cast("int"))
    pieces = F.when(F.col("part_words") > 0, F.array_append(whole, F.col("part_words"))).otherwise(whole)
    each = taken_from(rows, shares).where("taken > 0").withColumn("words", F.explode(pieces))
    text = F.col(f"row.{text_col}")
    cut = F.array_join(F.slice(words_of(text), 1, F.col("words").cast("int")), " ")
    shown = F.when((F.col("words") < 0) | (F.col("words") == F.col("size")), text).otherwise(cut)
    return each.select(*[shown.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in df.columns])
