"""Lines, chat pairs, frames and text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import chat, ids, text
from lexiloom.plans import sql
from lexiloom.plans.prepare import framed
from lexiloom.plans.train import looks_like_chat
from lexiloom.sources.lines import drop_blank, explode_lines, with_fallback
from lexiloom.sources.pairs import chat_pairs
from lexiloom.sources.tables import table

TAIL_BYTES = 127
TAIL_TOKENS = 63
ID_LIMIT = 2000
REPLY_PREFIX = "reply> "
IDS_PREFIX = "reply_ids>"


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", "text")


def _pairs(spark: SparkSession, directory: str) -> DataFrame:
    return chat_pairs(table(spark, directory, "conversations"))


def _users(spark: SparkSession, directory: str) -> DataFrame:
    turns = table(spark, directory, "conversations")
    return turns.where(F.col("role") == "user").select("conv_id", "turn", "text")


def lines_scan(spark: SparkSession, directory: str) -> DataFrame:
    lines = explode_lines(_documents(spark, directory))
    return lines.select("doc_id", "line_no", F.md5("line").alias("line_md5"))


def lines_nonblank(spark: SparkSession, directory: str) -> DataFrame:
    lines = drop_blank(explode_lines(_documents(spark, directory)))
    return lines.select("doc_id", "line_no", F.md5("line").alias("line_md5"))


_LINES = """
  SELECT doc_id, unnest(range(len(l)))::INT AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: x <> '') AS l
        FROM documents)"""


def fallback_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """A corpus that has lines and one that has none."""
    docs = table(spark, directory, "documents")
    present = with_fallback(explode_lines(docs.select("doc_id", "text")))
    absent = with_fallback(explode_lines(docs.where(F.col("n_chars") < 0).select("doc_id", "text")))
    both = present.withColumn("corpus", F.lit("present")).unionByName(
        absent.withColumn("corpus", F.lit("absent"))
    )
    return both.groupBy("corpus", F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))


def pairs_query(spark: SparkSession, directory: str) -> DataFrame:
    return _pairs(spark, directory).select(
        "conv_id", "turn", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5")
    )


def _column_query(function, name: str, source=_documents, keys=("doc_id",)):
    """A query that applies one column function to every text of a table."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        return source(spark, directory).select(*keys, F.md5(function(F.col("text"))).alias(name))

    return run


def sample_legacy(spark: SparkSession, directory: str) -> DataFrame:
    sample = chat.legacy_sample(F.col("input"), F.col("output"))
    return _pairs(spark, directory).select("conv_id", "turn", F.md5(sample).alias("sample_md5"))


def sample_im(spark: SparkSession, directory: str) -> DataFrame:
    samples = framed(_pairs(spark, directory))
    return samples.select("conv_id", "turn", F.md5("sample").alias("sample_md5"))


VARIANTS = {
    "whole": ("<|user|> ", " <|assistant|> ", " <|end|>"),
    "no_end": ("<|user|> ", " <|assistant|> ", ""),
    "no_reply": ("<|user|> ", " ", " <|end|>"),
    "swapped": ("<|assistant|> ", " <|user|> ", " <|end|>"),
    "doubled": ("<|user|> ", " <|assistant|> ", " <|end|> <|user|> x <|assistant|> y <|end|>"),
}


def convert_legacy(spark: SparkSession, directory: str) -> DataFrame:
    """Each pair in a whole frame and in four damaged ones."""
    parts = [
        F.struct(
            F.lit(name).alias("variant"),
            F.concat(F.lit(a), F.col("input"), F.lit(b), F.col("output"), F.lit(c)).alias("line"),
        )
        for name, (a, b, c) in VARIANTS.items()
    ]
    rows = _pairs(spark, directory).select("conv_id", "turn", F.explode(F.array(*parts)).alias("v"))
    converted = F.md5(chat.convert_legacy(F.col("v.line")))
    return rows.select("conv_id", "turn", "v.variant", converted.alias("converted_md5"))


_AFTER = "substr(line, strpos(line, '<|user|>') + 8)"
_REPLY = f"substr({_AFTER}, strpos({_AFTER}, '<|assistant|>') + 13)"


def tail_text(spark: SparkSession, directory: str) -> DataFrame:
    tail = text.byte_tail(F.col("text"), TAIL_BYTES)
    return _documents(spark, directory).select("doc_id", F.md5(F.hex(tail)).alias("tail_md5"))


def tail_tokens(spark: SparkSession, directory: str) -> DataFrame:
    tail = ids.tail_tokens(text.byte_ids(text.utf8(F.col("text"))), TAIL_TOKENS)
    return _documents(spark, directory).select("doc_id", ids.join_ids(tail).alias("tail"))


def parse_id_list(spark: SparkSession, directory: str) -> DataFrame:
    """Order keys and part numbers as a list; some are too large and some are no numbers."""
    c = F.col
    written = F.concat(
        c("l_orderkey"), F.lit(", "), c("l_partkey"), F.lit("\t"), c("l_suppkey"), F.lit("  "),
        F.when(c("l_returnflag") == "R", "x").otherwise("+"), c("l_linenumber"), F.lit(","),
    )
    parsed = ids.parse_id_list(written, ID_LIMIT)
    return table(spark, directory, "lineitem").select(
        "l_orderkey", "l_linenumber", ids.join_ids(parsed).alias("id_list")
    )


def _outputs(spark: SparkSession, directory: str) -> DataFrame:
    """What a run prints per pair: the prompt, two replies and two lines of token ids."""
    output = F.concat(
        F.lit("you> "), F.col("input"), F.lit("\n" + REPLY_PREFIX), F.col("output"),
        F.lit("\n" + REPLY_PREFIX + "again\n" + IDS_PREFIX + "\n" + IDS_PREFIX + " "),
        F.concat_ws(" ", F.length("input"), F.length("output"), "turn"), F.lit("\n"),
    )
    return _pairs(spark, directory).select("conv_id", "turn", output.alias("output"))


def reply_first(spark: SparkSession, directory: str) -> DataFrame:
    reply = chat.first_reply(F.col("output"), REPLY_PREFIX)
    return _outputs(spark, directory).select("conv_id", "turn", F.md5(reply).alias("reply_md5"))


def reply_ids_last(spark: SparkSession, directory: str) -> DataFrame:
    found = chat.last_reply_ids(F.col("output"), IDS_PREFIX)
    return _outputs(spark, directory).select("conv_id", "turn", ids.join_ids(found).alias("id_list"))


def clean_reply(spark: SparkSession, directory: str) -> DataFrame:
    raw = F.concat(
        F.lit("<pad> \t"), F.col("output"), F.lit("<|im_start|> <|im_end|>"), F.col("input"), F.lit("<|im_end|>")
    )
    return _pairs(spark, directory).select("conv_id", "turn", F.md5(chat.clean_reply(raw)).alias("reply_md5"))


def cut_end_tag(spark: SparkSession, directory: str) -> DataFrame:
    sample = chat.legacy_sample(F.col("input"), F.col("output"))
    cut = chat.cut_at_end_tag(F.concat(sample, sample))
    return _pairs(spark, directory).select("conv_id", "turn", F.md5(cut).alias("cut_md5"))


def looks_like_chat_query(spark: SparkSession, directory: str) -> DataFrame:
    """The plain documents, and the chat samples in both frames."""
    pairs = _pairs(spark, directory).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    corpora = {
        "documents": looks_like_chat(_documents(spark, directory), "doc_id", "text"),
        "legacy": looks_like_chat(
            pairs.select("id", chat.legacy_sample(F.col("input"), F.col("output")).alias("text")), "id", "text"
        ),
        "im": looks_like_chat(framed(pairs), "id", "sample"),
    }
    first, *rest = [df.withColumn("corpus", F.lit(name)) for name, df in corpora.items()]
    for df in rest:
        first = first.unionByName(df)
    return first.select("corpus", "looks_like_chat")


_DOCS = "FROM documents"
_PROMPTS = "FROM conversations WHERE role = 'user'"

QUERIES = {
    "lines_scan": lines_scan,
    "lines_nonblank": lines_nonblank,
    "fallback_corpus": fallback_corpus,
    "chat_pairs": pairs_query,
    "sanitize_ascii": _column_query(text.sanitize_ascii, "text_md5"),
    "sanitize_unicode": _column_query(text.sanitize_unicode, "text_md5"),
    "normalize_text": _column_query(text.normalize, "text_md5"),
    "prompt_legacy": _column_query(chat.legacy_prompt, "prompt_md5", _users, ("conv_id", "turn")),
    "prompt_im": _column_query(chat.im_prompt, "prompt_md5", _users, ("conv_id", "turn")),
    "sample_legacy": sample_legacy,
    "sample_im": sample_im,
    "convert_legacy": convert_legacy,
    "tail_text": tail_text,
    "tail_tokens": tail_tokens,
    "parse_id_list": parse_id_list,
    "reply_first": reply_first,
    "reply_ids_last": reply_ids_last,
    "clean_reply": clean_reply,
    "cut_end_tag": cut_end_tag,
    "looks_like_chat": looks_like_chat_query,
}

_ID_TEXT = (
    "l_orderkey || ', ' || l_partkey || chr(9) || l_suppkey || '  ' || "
    "CASE WHEN l_returnflag = 'R' THEN 'x' ELSE '+' END || l_linenumber || ','"
)
_OUTPUT = (
    f"'you> ' || input || chr(10) || '{REPLY_PREFIX}' || output || chr(10) || '{REPLY_PREFIX}again' || chr(10) || "
    f"'{IDS_PREFIX}' || chr(10) || '{IDS_PREFIX} ' || length(input) || ' ' || length(output) || ' ' || turn || chr(10)"
)
_BREAK = r"\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}"

ORACLE = {
    "lines_scan": f"SELECT doc_id, line_no, md5(line) AS line_md5 FROM ({_LINES})",
    "lines_nonblank": (
        f"SELECT doc_id, line_no, md5(line) AS line_md5 FROM ({_LINES}) WHERE {sql.strip('line')} <> ''"
    ),
    "fallback_corpus": f"""
      SELECT 'present' AS corpus, md5(line) AS line_md5, count(*) AS n FROM ({_LINES}) GROUP BY 2
      UNION ALL
      SELECT 'absent', md5(line), 1 FROM (VALUES ('anna'), ('bob'), ('carol'), ('david'), ('emma'), ('frank')) t(line)
      WHERE NOT EXISTS (SELECT 1 FROM documents WHERE n_chars < 0)""",
    "chat_pairs": f"SELECT conv_id, turn, md5(input) AS input_md5, md5(output) AS output_md5 FROM ({sql.PAIRS})",
    "sanitize_ascii": f"SELECT doc_id, md5({sql.sanitize_ascii('text')}) AS text_md5 {_DOCS}",
    "sanitize_unicode": f"SELECT doc_id, md5({sql.strip('lower(' + sql.spaced('text') + ')')}) AS text_md5 {_DOCS}",
    "normalize_text": f"SELECT doc_id, md5({sql.normalize('text')}) AS text_md5 {_DOCS}",
    "prompt_legacy": (
        f"SELECT conv_id, turn, md5('<|user|> ' || {sql.sanitize_ascii('text')} || ' <|assistant|>') AS prompt_md5 {_PROMPTS}"
    ),
    "prompt_im": (
        f"SELECT conv_id, turn, md5('<|im_start|>user' || chr(10) || {sql.strip('lower(' + sql.spaced('text') + ')')} || "
        f"'<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt_md5 {_PROMPTS}"
    ),
    "sample_legacy": f"SELECT conv_id, turn, md5({sql.legacy('input', 'output')}) AS sample_md5 FROM ({sql.PAIRS})",
    "sample_im": (
        f"SELECT conv_id, turn, md5({sql.im(sql.normalize('input'), sql.normalize('output'))}) AS sample_md5 FROM ({sql.PAIRS})"
    ),
    "convert_legacy": f"""
      WITH variants(variant, a, b, c) AS (VALUES {", ".join(str((k, *v)) for k, v in VARIANTS.items())}),
      rows AS (SELECT conv_id, turn, variant, a || input || b || output || c AS line FROM ({sql.PAIRS}), variants)
      SELECT conv_id, turn, variant, md5(CASE
        WHEN strpos(line, '<|user|>') = 0 OR strpos(line, '<|assistant|>') = 0 THEN line
        WHEN strpos({_AFTER}, '<|assistant|>') = 0 THEN NULL
        ELSE {sql.im(sql.normalize(f"split_part({_AFTER}, '<|assistant|>', 1)"),
                     sql.normalize(f"split_part({_REPLY}, '<|end|>', 1)"))}
        END) AS converted_md5 FROM rows""",
    "tail_text": f"SELECT doc_id, md5(right(hex(encode(text)), {2 * TAIL_BYTES})) AS tail_md5 {_DOCS}",
    "tail_tokens": f"""
      SELECT doc_id, array_to_string(list_transform({sql.hexes('text')}[-{TAIL_TOKENS}:], lambda h: ('0x' || h)::INT), ',') AS tail
      {_DOCS}""",
    "parse_id_list": f"""
      SELECT l_orderkey, l_linenumber, CASE WHEN len(list_filter(v, lambda x: x IS NULL OR x NOT BETWEEN 0 AND {ID_LIMIT - 1})) = 0
        THEN array_to_string(v, ',') END AS id_list
      FROM (SELECT l_orderkey, l_linenumber, list_transform(
              list_filter(regexp_split_to_array({_ID_TEXT}, '[, \\t\\r\\n]+'), lambda p: p <> ''),
              lambda p: CASE WHEN regexp_matches(p, '^[+-]?[0-9]+$') THEN try_cast(ltrim(p, '+') AS BIGINT) END) AS v
            FROM lineitem)""",
    "reply_first": f"""
      SELECT conv_id, turn, md5(lower({sql.strip(f"regexp_extract(o, '(?:^|[{_BREAK}]){REPLY_PREFIX}([^{_BREAK}]*)', 1)")})) AS reply_md5
      FROM (SELECT conv_id, turn, {_OUTPUT} AS o FROM ({sql.PAIRS}))""",
    "reply_ids_last": f"""
      SELECT conv_id, turn, length(input) || ',' || length(output) || ',' || turn AS id_list FROM ({sql.PAIRS})""",
    "clean_reply": f"""
      SELECT conv_id, turn, md5({sql.strip("split_part(replace(replace('<pad> ' || chr(9) || output || '<|im_start|>' || chr(160) || '<|im_end|>' || input || '<|im_end|>', '<|im_start|>', ' '), '<pad>', ' '), '<|im_end|>', 1)")}) AS reply_md5
      FROM ({sql.PAIRS})""",
    "cut_end_tag": (
        f"SELECT conv_id, turn, md5(split_part({sql.legacy('input', 'output')}, '<|end|>', 1)) AS cut_md5 FROM ({sql.PAIRS})"
    ),
    "looks_like_chat": f"""
      WITH corpora AS (
        SELECT 'documents' AS corpus, doc_id::VARCHAR AS id, text FROM documents
        UNION ALL SELECT 'legacy', conv_id || '-' || turn, {sql.legacy('input', 'output')} FROM ({sql.PAIRS})
        UNION ALL SELECT 'im', conv_id || '-' || turn, {sql.im(sql.normalize('input'), sql.normalize('output'))} FROM ({sql.PAIRS})),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY md5('42:' || id), id) AS r FROM corpora)
      SELECT corpus, bool_or((contains(text, '<|user|>') AND contains(text, '<|assistant|>'))
        OR (contains(text, '<|im_start|>') AND contains(text, 'assistant'))) AS looks_like_chat
      FROM ranked WHERE r <= 8 GROUP BY corpus""",
}
