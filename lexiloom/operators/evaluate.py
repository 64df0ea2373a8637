"""Scoring of replies against a case table, reports, history and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.scoring import (
    case_score,
    excess_words,
    garbled_share,
    keyword_hits,
    repeated_share,
    style_ok,
)
from lexiloom.operators.order import range_bucket, running
from lexiloom.session import stored

# Rows that one report document can hold.
REPORT_ROWS = 10_000

CASES = [
    ("greeting", "hello there, keeper", ["hallo", "the", "is", "bon"]),
    ("weather", "how is the weather at the tower", ["ent", "sch", "tion"]),
    ("night", "is it dark already", ["nacht", "an", "eaux", "que"]),
    ("lamp", "did you light the lamp", ["lamp", "er", "ou", "ich", "ing"]),
    ("storm", "a storm is coming", ["storm", "est", "ung"]),
    ("ships", "have you seen a ship", ["ship", "th", "le", "die"]),
    ("supper", "what is for supper", ["ción", "re", "keit"]),
    ("letters", "any letters today", ["letter", "and", "on", "es", "los"]),
    ("stairs", "how many stairs are there", ["ement", "qui", "ver"]),
    ("gulls", "the gulls are loud", ["gull", "at", "in"]),
    ("paint", "the door needs paint", ["lich", "of", "pa", "ado"]),
    ("boat", "the boat has a leak", ["boat", "un", "her", "chen"]),
    ("clock", "what time is it", ["zeit", "ar", "ment"]),
    ("visit", "may i come to visit", ["ei", "to", "la", "ion"]),
    ("thanks", "thank you, keeper", ["thank", "are", "ne"]),
    ("goodbye", "see you tomorrow", ["morgen", "el", "ble", "sh"]),
]


def case_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *case) for i, case in enumerate(CASES)]
    return spark.createDataFrame(rows, "case_no int, case_id string, prompt string, keywords array<string>")


def score_replies(replies: DataFrame, cases: DataFrame, case: str = "case_no", reply: str = "reply") -> DataFrame:
    """Add the case, the keyword hits, the style flag and the score of each reply."""
    text = F.lower(F.col(reply))
    return (
        replies.join(cases, case)
        .withColumn("hits", keyword_hits(text, F.col("keywords")))
        .withColumn("style_ok", style_ok(text))
        .withColumn("score", case_score(F.size("hits"), F.size("keywords"), F.col("style_ok")))
    )


def average_score(scored: DataFrame) -> DataFrame:
    """Mean score of each case and, under the name ``all``, of all replies."""
    per_case = scored.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
    return (
        per_case.rollup("case_id")
        .agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avg_score"))
        .select(F.coalesce("case_id", F.lit("all")).alias("case_id"), "n", "avg_score")
    )


def latest_per_case(scored: DataFrame, order: list[str]) -> DataFrame:
    """The last reply of each case, found by aggregation."""
    row = F.struct(*[F.col(c) for c in scored.columns])
    latest = scored.groupBy("case_id").agg(F.max_by(row, F.struct(*order)).alias("r"))
    return latest.select("r.*")


def report_document(per_case: DataFrame) -> DataFrame:
    """One JSON text ``{avg_score, cases}`` for rows that hold one reply per case, at most ``REPORT_ROWS``."""
    case = F.struct(
        F.col("case_id").alias("id"), "prompt", "reply", "score", "hits", "style_ok"
    )
    too_many = F.raise_error(F.lit(f"a report holds at most {REPORT_ROWS} rows")).cast("string")
    return per_case.limit(REPORT_ROWS + 1).agg(
        F.when(F.count("*") > REPORT_ROWS, too_many).otherwise(F.to_json(
            F.struct(
                F.round(F.avg("score"), 6).alias("avg_score"),
                F.array_sort(F.collect_list(case)).alias("cases"),
            )
        )).alias("report")
    )


def report_lines(scored: DataFrame) -> Column:
    """The text form of one scored reply (a fixed format)."""
    shown = F.when(F.size("hits") == 0, "-").otherwise(F.array_join("hits", ", "))
    return F.concat_ws(
        "\n",
        F.format_string("[%s] score=%.2f style=%s", F.col("case_id"), F.col("score"), F.when(F.col("style_ok"), "ok").otherwise("bad")),
        F.concat(F.lit("prompt: "), F.col("prompt")),
        F.concat(F.lit("reply:  "), F.col("reply")),
        F.concat(F.lit("hits:   "), shown),
    )


def score_history(scored: DataFrame, run: str, case: str = "case_id") -> DataFrame:
    """Mean score of each case in each run, with the run before it and the change."""
    per_run = stored(scored.groupBy(case, run).agg(F.avg("score").alias("score")), "scores")
    bucket = range_bucket(per_run, run)
    return running(per_run, "last", F.col("score"), bucket, [run], (case,), "prev_score").withColumn(
        "delta", F.col("score") - F.col("prev_score")
    )


def with_penalties(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Add the words above the limit, the share of garbled characters and of repeated word pairs."""
    text = F.col(reply)
    return replies.withColumns(
        {
            "excess_words": excess_words(text),
            "garbled": garbled_share(text),
            "repeated": repeated_share(text),
        }
    )


def compare_replies(replies: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Replies next to the expected ones; either side is NULL where the other has no partner."""
    return replies.join(expected, key, "full_outer").withColumn(
        "status",
        F.when(F.col("reply").isNull(), "missing")
        .when(F.col("expected").isNull(), "extra")
        .when(F.col("reply") == F.col("expected"), "same")
        .otherwise("different"),
    )


def sweep_summary(losses: DataFrame, columns: list[str]) -> DataFrame:
    """Mean loss per configuration, per value of each single setting, and overall."""
    spark = losses.sparkSession
    names = ", ".join(columns)
    sets = ", ".join([f"({names})", *[f"({c})" for c in columns], "()"])
    return spark.sql(
        f"SELECT {names}, count(*) AS n, avg(loss) AS loss FROM {{losses}} GROUP BY GROUPING SETS ({sets})",
        losses=losses,
    )
