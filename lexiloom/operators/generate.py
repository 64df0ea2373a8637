"""Batch generation: every unfinished row of a prompt table is continued token by token.

A row's next token is drawn in the context of the longest suffix of its tokens that the model has seen. Models
of up to ``KERNEL_ENTRIES`` entries travel to the tasks, which continue whole batches of rows to their ends. Of
a larger one the most frequent contexts travel, as many as fit, and all rows go on there until they come to a
context of full length that is not among them. Only then the others are asked, which stay tables, two levels deep:
the suffixes of all lengths, each with the bounds of its blocks, and the blocks of at most ``BLOCK_ENTRIES`` tokens.
A round probes the first table with all longer suffixes of the rows at once, keeps the longest that is there, and
fetches the one block that the row's draw falls into. Both tables are dealt out and sorted once, before the first
round, so that a round moves its rows only and never the model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.chat import END_TAG, close_turn, legacy_prompt
from lexiloom.functions.ids import tail_tokens
from lexiloom.functions.text import byte_ids, byte_tail
from lexiloom.operators.kernels import STATE, ContextModel, Continuer, advance_batches, continue_batches
from lexiloom.operators.ngram import BYTES, Alphabet, cumulative, place_in, whole_counts
from lexiloom.session import cut_lineage

# Entries that travel, 12 bytes each, and 16 for each context. They pass through the driver.
KERNEL_ENTRIES = 3 << 20
# Steps per doubling of a context's total by which contexts are ranked.
GRADES = 8
BLOCK_ENTRIES = 256
# Entries of the contexts of one length that are broadcast, of those that stay tables.
HOT_ENTRIES = 1 << 18
# Entries of the model in one part of its tables.
ENTRIES_PER_PART = 1 << 18


def free_prompts(seeds: DataFrame, key: str, block: int) -> DataFrame:
    """Nothing to continue: up to ``block`` tokens from the start of a document."""
    return seeds.select(key, F.array().cast("array<int>").alias("prompt"), F.lit(block).alias("budget"))


def byte_prompts(prompts: DataFrame, key: str, text: str, block: int, closed: bool = False) -> DataFrame:
    """Legacy-framed prompts, cut to their last ``block - 1`` bytes; the rest of a block is the budget.

    With ``closed``, the tag between prompt and reply is one byte (see :func:`close_turn`).
    """
    frame = legacy_prompt(F.col(text))
    tail = byte_ids(byte_tail(close_turn(frame) if closed else frame, block - 1))
    return prompts.select(key, tail.alias("prompt")).withColumn(
        "budget", F.lit(block - 1) - F.size("prompt")
    )


def token_prompts(prompts: DataFrame, key: str, tokens: str, block: int, max_new: int) -> DataFrame:
    """The last ``block - 1`` ids of non-empty prompts; at most ``max_new`` tokens follow."""
    if max_new <= 0:
        raise ValueError("max_new must be positive")
    return (
        prompts.where(F.size(tokens) > 0)
        .select(key, tail_tokens(F.col(tokens), block - 1).alias("prompt"))
        .withColumn("budget", F.least(F.lit(max_new), F.lit(block) - F.size("prompt")))
    )


def _pack(prompt: Column, order: int, alphabet: Alphabet) -> Column:
    """The last ``order - 1`` ids as one number, pads where the prompt is shorter."""
    padded = F.concat(F.array_repeat(F.lit(alphabet.pad), order - 1), prompt)
    last = F.slice(padded, F.greatest(F.size(padded) - (order - 2), F.lit(1)), F.lit(order - 1))
    start = F.lit(0).cast("bigint")
    if order == 1:
        return start
    return F.aggregate(last, start, lambda acc, t: acc * alphabet.base + t)


def back_off_table(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two levels over cumulative entries: (model_order, context, n, bounds) and (model_order, context, block, steps).

    ``bounds`` are the upper ends of a context's blocks, ``steps`` the upper ends and tokens in one of them.
    """
    place = F.row_number().over(Window.partitionBy("model_order", "context").orderBy("next"))
    placed = entries.withColumn("block", F.floor((place - 1) / BLOCK_ENTRIES).cast("int"))
    blocks = cut_lineage(
        placed.groupBy("model_order", "context", "block").agg(
            # at most BLOCK_ENTRIES entries
            F.array_sort(F.collect_list(F.struct("hi", "next"))).alias("steps"),
            F.max("hi").alias("hi"),
            F.sum("n").alias("n"),
        )
    )
    heads = blocks.groupBy("model_order", "context").agg(
        # at most one bound per BLOCK_ENTRIES ids of the alphabet
        F.array_sort(F.collect_list("hi")).alias("bounds"),
        F.sum("n").alias("n"),
    )
    return cut_lineage(heads), blocks.drop("hi", "n")


class _Table:
    """A table of the model split once: the contexts that hold a large share of it, broadcast, and the others.

    The others are cached in ``parts`` by their keys, in order, so that joins neither shuffle nor sort them; a lost
    part is made again from its checkpoint.
    """

    def __init__(self, table: DataFrame, hot: DataFrame, keys: list[str], value: str, parts: int):
        names = ["model_order", "context"]
        self.keys, self.value = keys, value
        hot_rows = cut_lineage(table.join(F.broadcast(hot), names, "left_semi").select(*keys, F.col(value).alias("_hot")))
        self.hot = None if hot_rows.isEmpty() else hot_rows
        cold = table.join(F.broadcast(hot), names, "left_anti")
        cold = cut_lineage(cold.select(*[F.col(k).alias(f"_cold_{k}") for k in keys], F.col(value).alias("_cold")))
        placed = [f"_cold_{k}" for k in keys]
        self.cold = cold.repartition(parts, *placed).sortWithinPartitions(*placed).persist()
        # only a cache that is filled tells a plan how it is dealt out
        self.cold.count()

    def attach(self, rows: DataFrame, salt: str) -> DataFrame:
        """Add ``value``, NULL where the keys are in neither part. Rows found in the hot part match nothing cold."""
        apart = -1 - F.pmod(F.xxhash64(salt), F.lit(4096)).cast("int")
        if self.hot is None:
            keyed = rows.withColumn("_hot", F.lit(None).cast(self.cold.schema["_cold"].dataType))
        else:
            keyed = rows.join(F.broadcast(self.hot), self.keys, "left")
        sought = F.col("_hot").isNull() & F.col("model_order").isNotNull()
        keyed = keyed.withColumn("_order", F.when(sought, F.col("model_order")).otherwise(apart))
        same = F.col("_order") == F.col("_cold_model_order")
        for k in self.keys[1:]:
            same = same & (F.col(k) == F.col(f"_cold_{k}"))
        joined = keyed.join(self.cold, same, "left").withColumn(self.value, F.coalesce("_hot", "_cold"))
        return joined.drop("_hot", "_cold", "_order", *[f"_cold_{k}" for k in self.keys])


def _travelling(entries: DataFrame, room: int) -> tuple[Column, int]:
    """Which entries travel, and how many stay: the shortest context, and the most frequent others while there is room.

    Contexts of totals within an eighth of a doubling go or stay together.
    """
    grade = F.floor(F.log2("total") * GRADES)
    shortest = F.col("model_order") == 1
    # at most GRADES rows for each doubling that a total can have
    graded = entries.groupBy(F.when(~shortest, grade).alias("grade")).agg(F.count("*").alias("n")).collect()
    sizes = {r["grade"]: r["n"] for r in graded}
    room -= sizes.pop(None, 0)
    least = None
    for g in sorted(sizes, reverse=True):
        if sizes[g] > room:
            break
        room, least = room - sizes.pop(g), g
    return shortest if least is None else shortest | (grade >= least), sum(sizes.values())


def _by_rounds(
    prompts: DataFrame, key: str, entries: DataFrame, rounds: int, alphabet: Alphabet, rows: dict, room: int
) -> DataFrame:
    order, seed, whole = rows["order"], rows["seed"], rows["whole"]
    travels, stay = _travelling(entries, room)
    kernel = advance_batches(Continuer(_model(entries.where(travels)), partial=True, **rows))
    heads, blocks = back_off_table(entries.where(~travels))
    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), stay // ENTRIES_PER_PART)
    share = max(1, HOT_ENTRIES // alphabet.base)
    per_order = heads.groupBy("model_order").agg(F.sum("n").alias("grand"))
    hot = heads.join(F.broadcast(per_order), "model_order").where(F.col("n") * share >= F.col("grand"))
    hot = cut_lineage(hot.select("model_order", "context"))
    head_table = _Table(heads, hot, ["model_order", "context"], "bounds", parts)
    block_table = _Table(blocks, hot, ["model_order", "context", "block"], "steps", parts)
    bases = F.array(*[F.lit(alphabet.base ** (k - 1)).cast("bigint") for k in range(1, order + 1)])
    # of what a row has said, a round moves as many tokens as the end tag may reach back; rows of one key stay apart
    kept = ["row", "key", "full", "last", "size", "budget"]
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    state = cut_lineage(
        prompts.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(key).alias("key"),
            _pack(F.col("prompt"), order, alphabet).alias("full"),
            F.array().cast("array<int>").alias("last"),
            F.lit(0).alias("size"),
            "budget",
            F.lit(-1).alias("given"),
            F.lit(False).alias("asked"),
        )
    )
    kind = prompts.schema[key].dataType.simpleString()
    said = []
    # each round goes on by one token at least
    for step in range(rounds + 1):
        state = state.select(*kept, name.alias("name"), "given", "asked").mapInArrow(kernel, STATE.format(kind=kind))
        state = cut_lineage(state)
        said.append(state.select("row", "key", F.lit(step).alias("step"), "out", "size"))
        state = state.where(~F.col("done"))
        if state.isEmpty():
            break
        # the suffixes longer than what travels, and the longest that is there
        longer = F.when(F.col("known") < order, F.sequence(F.col("known") + 1, F.lit(order)))
        probes = state.withColumn("model_order", F.explode_outer(longer))
        probes = probes.withColumn("context", F.col("full") % F.element_at(bases, F.coalesce("model_order", F.lit(1))))
        found = head_table.attach(probes, "row")
        hit = F.struct("model_order", "context", "bounds")
        longest = F.max_by(hit, F.when(F.col("bounds").isNotNull(), F.col("model_order"))).alias("hit")
        state = found.groupBy(*kept).agg(longest).select(*kept, "hit.*")
        at = F.concat(name, F.lit(":"), F.col("size"))
        state = state.withColumn("_u", place_in(F.element_at("bounds", -1), at, whole, seed))
        below = F.filter("bounds", lambda hi: hi <= F.col("_u"))
        state = block_table.attach(state.withColumn("block", F.size(below)).drop("bounds"), "row")
        above = F.filter("steps", lambda s: s["hi"] > F.col("_u"))
        token = F.get(above, F.lit(0))["next"]
        state = state.select(*kept, F.coalesce(token, F.lit(-1)).alias("given"), F.lit(True).alias("asked"))
    head_table.cold.unpersist()
    block_table.cold.unpersist()
    # at most ``rounds`` tokens of a row; an end tag may lie in several cuts
    pieces = F.array_sort(F.collect_list(F.struct("step", "out")))
    whole_out = reduce(DataFrame.unionByName, said).groupBy("row", "key")
    whole_out = whole_out.agg(pieces.alias("pieces"), F.max_by("size", "step").alias("size"))
    return whole_out.select(F.col("key").alias(key), F.slice(F.flatten("pieces.out"), F.lit(1), F.col("size")).alias("out"))


def _model(entries: DataFrame) -> ContextModel:
    ordered = entries.select("model_order", "context", "next", "hi").orderBy("model_order", "context", "next")
    return ContextModel(ordered.toArrow())


def generate(
    prompts: DataFrame,
    key: str,
    counts: DataFrame,
    order: int,
    rounds: int,
    alphabet: Alphabet = BYTES,
    temperature: float = 1.0,
    stop: int | None = None,
    end_tag: list[int] | None = None,
    seed: int | str = 42,
    by_rounds: bool = False,
) -> DataFrame:
    """Continue ``prompts(key, prompt, budget)``: (``key``, ``out`` ARRAY<INT>). Keys are unique.

    A context that was never seen falls back to a shorter one. A row ends at ``stop`` (not part of the
    output), when its output ends in ``end_tag`` (cut off), or with its budget, or after ``rounds`` tokens.
    The size of the model decides how much of it travels, unless ``by_rounds`` asks for none; the draws are the same.
    """
    alphabet.check(order)
    prompts = prompts.withColumn("budget", F.least("budget", F.lit(rounds)))
    whole = whole_counts(counts) and temperature == 1.0
    rows = {
        "order": order,
        "base": alphabet.base,
        "stop": alphabet.end if stop is None else stop,
        "end_tag": end_tag or [],
        "seed": seed,
        "whole": whole,
    }
    wanted = counts.where(F.col("model_order") <= order)
    total = F.sum("n").over(Window.partitionBy("model_order", "context"))
    entries = cumulative(wanted, temperature).withColumn("total", total)
    entries = cut_lineage(entries.select("model_order", "context", "next", "n", "hi", "total"))
    size = entries.count()
    if size == 0:
        return prompts.select(key, F.array().cast("array<int>").alias("out"))
    if by_rounds or size > KERNEL_ENTRIES:
        return _by_rounds(prompts, key, entries, rounds, alphabet, rows, 0 if by_rounds else KERNEL_ENTRIES)
    kind = prompts.schema[key].dataType.simpleString()
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    batch = prompts.select(F.col(key).alias("key"), name.alias("name"), _pack(F.col("prompt"), order, alphabet).alias("full"), "budget")
    kernel = continue_batches(Continuer(_model(entries), **rows))
    return batch.mapInArrow(kernel, f"key {kind}, out array<int>").withColumnRenamed("key", key)


END_TAG_BYTES = list(END_TAG.encode())
