"""Next-token models as count tables, and their losses.

The examples are documents: every token is a target, and so is the end marker. The model of order
``k`` predicts a target from the ``k - 1`` ids before it, left of the document all markers. Contexts
are packed into one BIGINT in base ``base``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.draws import draw, fraction
from lexiloom.operators.kernels import example_ngram_batches, ngram_batches

# A table of at most this many rows may be broadcast.
BROADCAST_ROWS = 1 << 17
# At most this many n-grams (or contexts) can each hold a HOT-th of a table's total.
HOT = 10_000

MIN_PROBABILITY = 1e-12


@dataclass(frozen=True)
class Alphabet:
    """Ids are below ``base``; ``pad`` fills contexts on the left, ``end`` (if any) ends a row.

    The first ``given`` ids of a row are context only: windows of a stream have one.
    """

    base: int
    pad: int
    end: int | None
    given: int = 0

    def check(self, order: int) -> None:
        if order < 1 or self.base**order >= 1 << 62:
            raise ValueError(f"order {order} is out of range for {self.base} ids")


BYTES = Alphabet(base=257, pad=256, end=256)
BYTE_WINDOWS = Alphabet(base=257, pad=256, end=None, given=1)


def tally_ngrams(
    docs: DataFrame, tokens: str, orders: list[int], alphabet: Alphabet = BYTES
) -> DataFrame:
    """(model_order, context, next, n, w) over all targets of all rows.

    ``tokens`` is a STRING column (its UTF-8 bytes) or an ARRAY<INT>. In ``n`` a target counts 1, in
    ``w`` one over the number of targets of its row, so each row weighs 1.
    """
    for order in orders:
        alphabet.check(order)
    kernel = ngram_batches(orders, alphabet.base, alphabet.pad, alphabet.end, alphabet.given)
    return (
        docs.select(tokens)
        .mapInArrow(kernel, "model_order int, context bigint, next int, n bigint, w double")
        .groupBy("model_order", "context", "next")
        .agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    )


def count_ngrams(
    docs: DataFrame,
    tokens: str,
    orders: list[int],
    alphabet: Alphabet = BYTES,
    weighting: str = "token",
) -> DataFrame:
    """(model_order, context, next, n), where ``n`` weighs tokens or examples alike."""
    if weighting not in ("token", "example"):
        raise ValueError("weighting must be 'token' or 'example'")
    value = F.col("n" if weighting == "token" else "w").alias("n")
    return tally_ngrams(docs, tokens, orders, alphabet).select("model_order", "context", "next", value)


def probabilities(counts: DataFrame) -> DataFrame:
    """Add the context's ``total`` and the relative count ``p``; a context has at most ``base`` rows."""
    total = F.sum("n").over(Window.partitionBy("model_order", "context"))
    return counts.withColumn("total", total).withColumn(
        "p", F.col("n").cast("double") / F.col("total").cast("double")
    )


def surprise(p: Column) -> Column:
    """Loss of a target that has probability ``p`` (NULL: never seen)."""
    return -F.ln(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(MIN_PROBABILITY)))


def _attach(grams: DataFrame, model: DataFrame, order: int, alphabet: Alphabet, salt: Column) -> DataFrame:
    """Left join of n-grams to ``model(context, next, n, p)`` of one order.

    A model that is small by construction is broadcast. Of a larger one, the n-grams that hold a
    large share of all targets are broadcast (at most HOT), and rows found there are spread over
    keys that match nothing, so no key of the shuffle join is hot.
    """
    lookup = model.select("context", "next", "p")
    if alphabet.base**order <= BROADCAST_ROWS:
        return grams.join(F.broadcast(lookup), ["context", "next"], "left")
    grand = model.agg(F.sum("n").alias("n")).scalar()
    is_hot = F.col("n") * HOT >= grand
    hot = model.where(is_hot).select("context", "next", F.col("p").alias("p_hot"))
    cold = model.where(~is_hot).select(F.col("context").alias("_context"), F.col("next").alias("_next"), "p")
    marked = grams.join(F.broadcast(hot), ["context", "next"], "left").withColumn(
        "_key",
        F.when(F.col("p_hot").isNull(), F.col("context")).otherwise(-1 - F.pmod(F.xxhash64(salt), F.lit(4096))),
    )
    return (
        marked.join(cold, (F.col("_key") == F.col("_context")) & (F.col("next") == F.col("_next")), "left")
        .withColumn("p", F.coalesce("p_hot", "p"))
        .drop("p_hot", "_key", "_context", "_next")
    )


def example_loss(
    docs: DataFrame, key: str, tokens: str, counts: DataFrame, order: int, alphabet: Alphabet = BYTES
) -> DataFrame:
    """Mean loss over the targets of each row: (``key``, loss)."""
    alphabet.check(order)
    kind = docs.schema[key].dataType.simpleString()
    grams = docs.select(key, tokens).mapInArrow(
        example_ngram_batches(order, alphabet.base, alphabet.pad, alphabet.end, alphabet.given),
        f"id {kind}, context bigint, next int, n bigint",
    )
    model = probabilities(counts.where(F.col("model_order") == order))
    return (
        _attach(grams, model, order, alphabet, F.col("id"))
        .groupBy(F.col("id").alias(key))
        .agg((F.sum(F.col("n") * surprise(F.col("p"))) / F.sum("n")).alias("loss"))
    )


def split_loss(
    docs: DataFrame,
    tokens: str,
    counts: DataFrame,
    orders: list[int],
    alphabet: Alphabet = BYTES,
) -> DataFrame:
    """Mean of the rows' mean losses, per order: (model_order, n_examples, loss).

    The evaluated rows are reduced to weighted n-grams first, so both sides of the join have one
    row per n-gram and no key is hot.
    """
    weights = tally_ngrams(docs, tokens, orders, alphabet).drop("n")
    model = probabilities(counts).select("model_order", "context", "next", "p")
    return _mean_loss(weights.join(model, ["model_order", "context", "next"], "left"))


def own_loss(tallied: DataFrame) -> DataFrame:
    """``split_loss`` of the very rows that were tallied: their counts are the model, no join."""
    return _mean_loss(probabilities(tallied))


def _mean_loss(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("model_order").agg(
        F.round(F.sum("w")).cast("bigint").alias("n_examples"),
        (F.sum(F.col("w") * surprise(F.col("p"))) / F.sum("w")).alias("loss"),
    )


def with_temperature(counts: DataFrame, temperature: float) -> DataFrame:
    """Add ``p``, the softmax over a context of ``ln(relative count) / temperature``."""
    context = Window.partitionBy("model_order", "context")
    logit = F.ln("p") / F.lit(max(temperature, 1e-4))
    return (
        probabilities(counts)
        .withColumn("_logit", logit)
        .withColumn("_e", F.exp(F.col("_logit") - F.max("_logit").over(context)))
        .withColumn("p", F.col("_e") / F.greatest(F.sum("_e").over(context), F.lit(1e-9)))
        .drop("_logit", "_e", "total")
    )


def whole_counts(counts: DataFrame) -> bool:
    """Whether ``n`` counts targets, rather than weighing examples."""
    return counts.schema["n"].dataType.typeName() in ("long", "integer")


def sampling_weights(counts: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Add the weight ``w`` that a draw uses, in proportion to ``p ** (1 / temperature)``.

    At temperature 1, counts are their own weights. Else the weight is a DOUBLE relative to the
    likeliest token of the context, so no token of the context loses all its weight to rounding.
    """
    if temperature == 1.0:
        return counts.withColumn("w", F.col("n"))
    top = F.max("n").over(Window.partitionBy("model_order", "context"))
    return counts.withColumn("w", F.exp(F.ln(F.col("n") / top) / F.lit(max(temperature, 1e-4))))


def cumulative(counts: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Add the interval [lo, hi) of each token in its context, tokens in id order."""
    context = Window.partitionBy("model_order", "context").orderBy("next")
    zero = F.lit(0).cast("bigint") if whole_counts(counts) and temperature == 1.0 else F.lit(0.0)
    return (
        sampling_weights(counts, temperature)
        .withColumn("hi", F.sum("w").over(context.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("lo", F.lag("hi", 1).over(context))
        .withColumn("lo", F.coalesce("lo", zero))
    )


def place_in(total: Column, key: Column, whole: bool, seed: int | str) -> Column:
    """Where on the line of a context's intervals the draw of ``key`` falls."""
    return draw(key, total, seed) if whole else fraction(key, seed) * total


def cdf_draw(counts: DataFrame, temperature: float = 1.0, seed: int | str = 42) -> DataFrame:
    """One drawn token per context: the interval that holds the context's own draw."""
    total = F.max("hi").over(Window.partitionBy("model_order", "context"))
    whole = whole_counts(counts) and temperature == 1.0
    return (
        cumulative(counts, temperature)
        .withColumn("u", place_in(total, F.col("context"), whole, seed))
        .where((F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi")))
        .select("model_order", "context", "next")
    )


def model_size(counts: DataFrame) -> DataFrame:
    """Entries, contexts and counted targets per order."""
    per_context = counts.groupBy("model_order", "context").agg(
        F.count("*").alias("entries"), F.sum("n").alias("n")
    )
    return per_context.groupBy("model_order").agg(
        F.sum("entries").alias("n_entries"), F.count("*").alias("n_contexts"), F.sum("n").alias("n_targets")
    )
