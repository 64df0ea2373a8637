"""How filters interact: what each one removes at every place of every order, by part of a corpus.

A document becomes a mask of the filters it fails. Equal (part, mask, labels) are counted, and each of these few
cells folds its mask across the array of all filter orders: ``transform`` over the orders, ``aggregate`` over the
steps of one, giving a struct of weighted counts for every step of every order. The folded cells of a part are
merged by elementwise sums.

One filter fails copies: documents whose text also belongs to a smaller id. Texts are compared by SHA-256. All
rows of a text fail the other filters alike, so its rows are counted per text and part, and of each count only
the rows of the smallest id pass: no join brings a text's rows together, however many they are.

Defined results: a null text counts as empty, a null part as the empty string; a null id has no smaller one, so
its row is no copy, and it has no labels; rows of one id that share a text are not copies of each other; a
document is labelled 1 if any label row of its id says so; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import stored, text_or_empty
from lexiloom.llm.mixing import words_of

#: Whether a text, of these words, fails.
FAILURES: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: F.size(F.array_distinct(words)).cast("bigint") * 100 < F.size(words).cast("bigint") * 80,
    "C": lambda text, words: _upper(text).cast("bigint") * 100 > F.length(text).cast("bigint") * 10,
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The filter that fails copies.
COPIES = "E"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def _upper(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z]+", ""))


def masked(
    df: DataFrame, id_col: str, text_col: str, part_col: str, failures: dict[str, Callable[[Column, Column], Column]]
) -> DataFrame:
    """(doc_id, part, digest, mask, n): each distinct row's failures as bits, and how often the row is there."""
    texts = df.select(F.col(id_col).alias("doc_id"), text_or_empty(part_col).alias("part"), text_or_empty(text_col).alias("text"))
    split = texts.withColumn("words", words_of(F.col("text")))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(failures.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    rows = split.select("doc_id", "part", digest.alias("digest"), mask.cast("int").alias("mask"))
    return rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Add (good, toxic) by id. Rows without an id match nothing and are spread by their text."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    marks = marks.agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).withColumn("spread", F.lit(0))
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0).cast("bigint")
    joined = rows.withColumn("spread", apart).join(marks, ["doc_id", "spread"], "left").drop("spread")
    return joined.fillna(False, ["good", "toxic"])


def cells(rows: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, good, toxic, n): the counts of all cells, with ``copy_bit`` set for copies."""
    alike = ["digest", "part", "mask", "good", "toxic"]
    groups = rows.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first_id"),
        F.min_by("n", "doc_id").alias("n_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_no_id"),
    )
    # at most one row per part and label of a text
    smallest = F.min("first_id").over(Window.partitionBy("digest"))
    leads = F.coalesce(F.col("first_id") == smallest, F.lit(False))
    groups = groups.withColumn("originals", F.col("n_no_id") + F.when(leads, F.col("n_first")).otherwise(0))
    kinds = F.array(
        F.struct(F.lit(0).alias("bit"), F.col("originals").alias("n")),
        F.struct(F.lit(copy_bit).alias("bit"), (F.col("n") - F.col("originals")).alias("n")),
    )
    each = groups.select("part", "mask", "good", "toxic", F.explode(kinds).alias("kind")).where("kind.n > 0")
    mask = F.col("mask").bitwiseOR(F.col("kind.bit")).alias("mask")
    return each.groupBy("part", mask, "good", "toxic").agg(F.sum("kind.n").alias("n"))


def _counts(kept: Column, removed: Column, redundant: Column, unique: Column, good: Column, toxic: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in zip(COUNTS, (kept, removed, redundant, unique, good, toxic))])


def folded(orders: Column) -> Column:
    """The cell's weighted counts at each step of each order, one array of all."""
    none = F.lit(0).cast("bigint")
    weigh = lambda condition: F.when(condition, F.col("n")).otherwise(none)
    empty = F.filter(F.array(_counts(*[none] * len(COUNTS))), lambda _: F.lit(False))

    def step(state: Column, bit: Column) -> Column:
        fails = F.col("mask").bitwiseAND(bit) != 0
        removed = fails & ~state["gone"]
        counts = _counts(
            weigh(~fails & ~state["gone"]),
            weigh(removed),
            weigh(fails & state["gone"]),
            weigh(F.col("mask") == bit),
            weigh(removed & F.col("good")),
            weigh(removed & F.col("toxic")),
        )
        return F.struct((state["gone"] | fails).alias("gone"), F.array_append(state["steps"], counts).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), empty.alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def merged(parts: Column, length: int) -> Column:
    """Elementwise sums of arrays of counts."""
    zero = F.array_repeat(_counts(*[F.lit(0).cast("bigint")] * len(COUNTS)), length)
    add = lambda a, b: _counts(*[a[c] + b[c] for c in COUNTS])
    return F.aggregate(parts, zero, lambda total, part: F.zip_with(total, part, add))


def audit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    failures: dict[str, Callable[[Column, Column], Column]] = FAILURES,
) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    The filters are ``failures``, whose names are single letters, and ``COPIES`` after them.
    """
    names = [*failures, COPIES]
    ways = list(permutations(range(len(names))))
    orders = F.lit([[1 << i for i in way] for way in ways])
    shown = F.lit(["".join(names[i] for i in way) for way in ways])
    rows = stored(masked(df, id_col, text_col, part_col, failures), "masks")
    counts = cells(labelled(rows, labels, id_col), 1 << len(failures))
    # at most one cell per mask and label
    folds = counts.select("part", folded(orders).alias("steps")).groupBy("part").agg(F.collect_list("steps").alias("cells"))
    length = len(ways) * len(names)
    each = folds.select("part", F.posexplode(merged(F.col("cells"), length)).alias("at", "counts"))
    order = F.element_at(shown, F.expr(f"int(at div {len(names)}) + 1"))
    step = F.expr(f"int(at % {len(names)}) + 1")
    named = each.select("part", order.alias("filter_order"), step.alias("step"), "counts.*")
    named = named.withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    total = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return named.select("part", "filter_order", "step", "filter", *COUNTS, total.alias("shapley"))
