"""Assistant turns scored as replies to a case table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.draws import draw
from lexiloom.functions.text import WHITESPACE, normalize
from lexiloom.operators.evaluate import (
    CASES,
    average_score,
    case_table,
    compare_replies,
    latest_per_case,
    report_document,
    report_lines,
    score_history,
    score_replies,
    with_penalties,
)
from lexiloom.operators.keywords import find_keywords
from lexiloom.plans import sql
from lexiloom.sources.tables import spread, table

# Keywords of ``many_keyword_hits``: a top list of words.
KEYWORDS = 10_000


def _replies(spark: SparkSession, directory: str) -> DataFrame:
    """Each assistant turn as the reply to one case; the conversation is the run."""
    turns = table(spark, directory, "conversations").where(F.col("role") == "assistant")
    turn = F.concat_ws(":", "conv_id", "turn")
    return turns.select(
        "conv_id", "turn", draw(turn, len(CASES), "case").cast("int").alias("case_no"), F.col("text").alias("reply")
    )


def _scored(spark: SparkSession, directory: str) -> DataFrame:
    return score_replies(_replies(spark, directory), case_table(spark))


def keyword_hits(spark: SparkSession, directory: str) -> DataFrame:
    return _scored(spark, directory).select(
        "conv_id", "turn", "case_id", F.array_join("hits", ",").alias("hits")
    )


def style_ok(spark: SparkSession, directory: str) -> DataFrame:
    return _scored(spark, directory).select("conv_id", "turn", "style_ok")


def case_score(spark: SparkSession, directory: str) -> DataFrame:
    return _scored(spark, directory).select(
        "conv_id", "turn", "case_id", F.size("hits").alias("n_hits"), "style_ok", F.round("score", 6).alias("score")
    )


def avg_score(spark: SparkSession, directory: str) -> DataFrame:
    return average_score(_scored(spark, directory)).withColumn("avg_score", F.round("avg_score", 6))


def _latest(spark: SparkSession, directory: str) -> DataFrame:
    latest = latest_per_case(_scored(spark, directory), ["conv_id", "turn"])
    return latest.withColumn("score", F.round("score", 6)).withColumn("reply", F.lower("reply"))


def eval_report(spark: SparkSession, directory: str) -> DataFrame:
    """The report on the last reply of each case, read back from its JSON text."""
    report = report_document(_latest(spark, directory))
    schema = (
        "avg_score double, cases array<struct<id:string,prompt:string,reply:string,score:double,"
        "hits:array<string>,style_ok:boolean>>"
    )
    parsed = report.select(F.from_json("report", schema).alias("r"))
    return parsed.select("r.avg_score", F.explode("r.cases").alias("c")).select(
        "avg_score", "c.id", "c.prompt", F.md5("c.reply").alias("reply_md5"), "c.score",
        F.array_join("c.hits", ",").alias("hits"), "c.style_ok",
    )


def eval_report_text(spark: SparkSession, directory: str) -> DataFrame:
    scored = _scored(spark, directory)
    return scored.select("conv_id", "turn", F.md5(report_lines(scored)).alias("lines_md5"))


def score_history_query(spark: SparkSession, directory: str) -> DataFrame:
    history = score_history(_scored(spark, directory), "conv_id")
    return history.select(
        "case_id", F.col("conv_id").alias("run"),
        *[F.round(c, 6).alias(c) for c in ("score", "prev_score", "delta")],
    )


def reply_penalties(spark: SparkSession, directory: str) -> DataFrame:
    return with_penalties(_replies(spark, directory)).select(
        "conv_id", "turn", "excess_words", F.round("garbled", 6).alias("garbled"), F.round("repeated", 6).alias("repeated")
    )


def reply_compare(spark: SparkSession, directory: str) -> DataFrame:
    """Replies next to the turn before them; prompts without a reply and replies without a prompt stay."""
    turns = table(spark, directory, "conversations")
    replies = turns.where(F.col("role") == "assistant").select("conv_id", "turn", normalize(F.col("text")).alias("reply"))
    expected = turns.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), normalize(F.col("text")).alias("expected")
    )
    return compare_replies(replies, expected, ["conv_id", "turn"]).select(
        "conv_id", "turn", "status", F.md5("reply").alias("reply_md5"), F.md5("expected").alias("expected_md5")
    )


def many_keyword_hits(spark: SparkSession, directory: str) -> DataFrame:
    """The most frequent words of the documents as keywords of all replies."""
    spelled = F.split(F.lower("text"), WHITESPACE + "+")
    words = table(spark, directory, "documents").select(F.explode(spelled).alias("keyword")).where("keyword <> ''")
    counts = words.groupBy("keyword").agg(F.count("*").alias("n"))
    keywords = counts.orderBy(F.desc("n"), "keyword").limit(KEYWORDS)
    turns = spread(table(spark, directory, "conversations"), "conv_id", "turn").where(F.col("role") == "assistant")
    found = find_keywords(turns.select("conv_id", "turn", F.lower("text").alias("text")), keywords)
    return found.select(
        "conv_id", "turn", F.size("hits").cast("bigint").alias("n_hits"), F.md5(F.array_join("hits", ",")).alias("hits_md5")
    )


QUERIES = {
    "keyword_hits": keyword_hits,
    "many_keyword_hits": many_keyword_hits,
    "style_ok": style_ok,
    "case_score": case_score,
    "avg_score": avg_score,
    "eval_report": eval_report,
    "eval_report_text": eval_report_text,
    "score_history": score_history_query,
    "reply_penalties": reply_penalties,
    "reply_compare": reply_compare,
}

_CASES = ", ".join(
    f"({i}, '{case_id}', '{prompt}', {keywords})" for i, (case_id, prompt, keywords) in enumerate(CASES)
)
_TURN = "conv_id || ':' || turn"
_SCORED = f"""
  WITH cases(case_no, case_id, prompt, keywords) AS (VALUES {_CASES}),
  replies AS (SELECT conv_id, turn, text AS reply, {sql.draw(_TURN, str(len(CASES)), 'case')} AS case_no
              FROM conversations WHERE role = 'assistant'),
  matched AS (SELECT *, list_filter(keywords, lambda k: contains(lower(reply), k)) AS hits,
                len({sql.words('reply')}) <= 30 AS style_ok FROM replies JOIN cases USING (case_no)),
  scored AS (SELECT *, least(len(hits)::DOUBLE / greatest(len(keywords), 1)::DOUBLE
                + CASE WHEN style_ok THEN 0.1::DOUBLE ELSE 0::DOUBLE END, 1::DOUBLE) AS score FROM matched),
  latest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY conv_id DESC, turn DESC) = 1)"""

_W = sql.words("text")

ORACLE = {
    "many_keyword_hits": f"""
      WITH words AS (SELECT unnest({sql.words('lower(text)')}) AS keyword FROM documents),
      keywords AS (SELECT keyword FROM words GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT {KEYWORDS}),
      listed AS (SELECT list(keyword ORDER BY keyword) AS l FROM keywords),
      found AS (SELECT conv_id, turn, list_filter(l, lambda k: contains(lower(text), k)) AS hits
                FROM conversations, listed WHERE role = 'assistant')
      SELECT conv_id, turn, len(hits)::BIGINT AS n_hits, md5(array_to_string(hits, ',')) AS hits_md5 FROM found""",
    "keyword_hits": _SCORED + " SELECT conv_id, turn, case_id, array_to_string(hits, ',') AS hits FROM scored",
    "style_ok": _SCORED + " SELECT conv_id, turn, style_ok FROM scored",
    "case_score": _SCORED + """
      SELECT conv_id, turn, case_id, len(hits)::INT AS n_hits, style_ok, round(score, 6) AS score FROM scored""",
    "avg_score": _SCORED + """
      SELECT coalesce(case_id, 'all') AS case_id, count(*) AS n, round(avg(score), 6) AS avg_score
      FROM scored GROUP BY ROLLUP (case_id)""",
    "eval_report": _SCORED + """
      SELECT round(avg(round(score, 6)) OVER (), 6) AS avg_score, case_id AS id, prompt, md5(lower(reply)) AS reply_md5,
        round(score, 6) AS score, array_to_string(hits, ',') AS hits, style_ok FROM latest""",
    "eval_report_text": _SCORED + """
      SELECT conv_id, turn, md5('[' || case_id || '] score=' || printf('%.2f', score) || ' style='
        || CASE WHEN style_ok THEN 'ok' ELSE 'bad' END || chr(10) || 'prompt: ' || prompt || chr(10) || 'reply:  ' || reply
        || chr(10) || 'hits:   ' || CASE WHEN len(hits) = 0 THEN '-' ELSE array_to_string(hits, ', ') END) AS lines_md5
      FROM scored""",
    "score_history": _SCORED + """,
      runs AS (SELECT case_id, conv_id AS run, avg(score) AS score FROM scored GROUP BY case_id, conv_id),
      lagged AS (SELECT *, lag(score) OVER (PARTITION BY case_id ORDER BY run) AS prev FROM runs)
      SELECT case_id, run, round(score, 6) AS score, round(prev, 6) AS prev_score, round(score - prev, 6) AS delta FROM lagged""",
    "reply_penalties": f"""
      SELECT conv_id, turn, greatest(len(w) - 30, 0)::INT AS excess_words,
        round((length(text) - length(regexp_replace(text, '[\\x{{FFFD}}\\x00-\\x08\\x0e-\\x1b\\x7f]', '', 'g')))::DOUBLE / length(text), 6) AS garbled,
        round(CASE WHEN len(w) < 2 THEN 0 ELSE 1 - len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))::DOUBLE
          / (len(w) - 1) END, 6) AS repeated
      FROM (SELECT conv_id, turn, text, {_W} AS w FROM conversations WHERE role = 'assistant')""",
    "reply_compare": f"""
      WITH replies AS (SELECT conv_id, turn, {sql.normalize('text')} AS reply FROM conversations WHERE role = 'assistant'),
      expected AS (SELECT conv_id, turn + 1 AS turn, {sql.normalize('text')} AS expected FROM conversations WHERE role = 'user')
      SELECT conv_id, turn, CASE WHEN reply IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra'
        WHEN reply = expected THEN 'same' ELSE 'different' END AS status, md5(reply) AS reply_md5, md5(expected) AS expected_md5
      FROM replies FULL JOIN expected USING (conv_id, turn)""",
}
