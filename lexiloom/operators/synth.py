"""Templated chat samples: one per row of any keyed table, every choice drawn by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.chat import legacy_sample
from lexiloom.functions.draws import draw

# Subjects of a small printing works and the weight of each of their parts. One subject has several parts.
TOPICS = [
    ["letterpress"], ["misprints"], ["paper grain", "blotting paper", "handmade paper", "card stock"], ["the type case"],
    ["proofreading"], ["the delivery round"], ["bookbinding"], ["woodcuts"], ["the order book"], ["drying racks"],
    ["calendars"], ["the foot treadle"], ["margins"], ["ink"], ["the apprentice"],
]
PART_WEIGHTS = {1: [6], 4: [3, 1, 1, 1]}

PROMPTS = [
    "how does {topic} work here",
    "is {topic} difficult to learn",
    "show me something on {topic}",
    "why does {topic} matter so much",
    "who looks after {topic}",
]
REPLIES = [
    "most mornings begin with {topic}, and most evenings end with it too.",
    "we keep a whole shelf of notes on {topic}; take the blue folder.",
    "nobody agrees on {topic}, least of all the two of us.",
    "{topic} wants patience first and clean hands second.",
]
# Topics whose one reply has a slot, and the slot's values.
SLOTTED = {
    "calendars": ("the {slot} sheet is printed already, the others are waiting.", ["march", "june", "october"]),
    "ink": ("a spoon of {slot} goes a long way on this press.", ["umber", "prussian blue", "vermilion", "lamp black", "ochre"]),
}


def part_rows() -> list[tuple[int, int, int, str]]:
    """(lo, hi, topic, part): each part's interval of the weight line."""
    rows, at = [], 0
    for topic, parts in enumerate(TOPICS):
        for weight, part in zip(PART_WEIGHTS[len(parts)], parts):
            rows.append((at, at + weight, topic, part))
            at += weight
    return rows


def prompt_rows() -> list[tuple[str, int, str]]:
    return [
        (part, i, prompt.replace("{topic}", part))
        for parts in TOPICS
        for part in parts
        for i, prompt in enumerate(PROMPTS)
    ]


def reply_rows() -> list[tuple[str, int, str]]:
    rows = []
    for part in (p for parts in TOPICS for p in parts):
        if part in SLOTTED:
            template, values = SLOTTED[part]
            texts = [template.replace("{slot}", v) for v in values]
        else:
            texts = [r.replace("{topic}", part) for r in REPLIES]
        rows += [(part, i, t) for i, t in enumerate(texts)]
    return rows


def _numbered(spark: SparkSession, rows: list[tuple[str, int, str]], name: str) -> DataFrame:
    """The texts of a part in an array, so that a draw is an index."""
    parts = {part: [] for part, _, _ in rows}
    for part, _, text in rows:
        parts[part].append(text)
    return spark.createDataFrame(list(parts.items()), f"part string, {name} array<string>")


def synth_chat(ids: DataFrame, key: str, seed: int | str = 42) -> DataFrame:
    """One sample per id: (``key``, topic, part, user, assistant, sample)."""
    spark = ids.sparkSession
    rows = part_rows()
    total = rows[-1][1]
    # one row per unit of weight turns the interval lookup into an equi-join
    units = [(u, topic, part) for lo, hi, topic, part in rows for u in range(lo, hi)]
    lookup = (
        spark.createDataFrame(units, "unit int, topic int, part string")
        .join(_numbered(spark, prompt_rows(), "prompts"), "part")
        .join(_numbered(spark, reply_rows(), "replies"), "part")
    )
    key_text = F.col(key).cast("string")
    picked = ids.select(
        key, draw(F.concat(F.lit("topic:"), key_text), total, seed).cast("int").alias("unit")
    ).join(F.broadcast(lookup), "unit")

    def pick(texts: str):
        return F.get(
            F.col(texts),
            draw(F.concat(F.lit(f"{texts}:"), key_text), F.size(texts), seed).cast("int"),
        )

    return picked.select(
        key, "topic", "part", pick("prompts").alias("user"), pick("replies").alias("assistant")
    ).withColumn("sample", legacy_sample(F.col("user"), F.col("assistant")))
