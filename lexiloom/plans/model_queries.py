"""Count models: learning, losses, selection, sampling and generation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.chat import close_turn, legacy_sample
from lexiloom.functions.text import byte_ids, byte_tail
from lexiloom.operators import bpe
from lexiloom.operators.bpe import learn
from lexiloom.operators.generate import END_TAG_BYTES, byte_prompts, free_prompts, generate
from lexiloom.operators.ngram import (
    BYTE_WINDOWS,
    cdf_draw,
    count_ngrams,
    example_loss,
    model_size,
    own_loss,
    split_loss,
    tally_ngrams,
    with_temperature,
)
from lexiloom.operators.order import draw_rows, split_tail
from lexiloom.operators.selection import batch_loss, best_model, eval_steps, improvements
from lexiloom.operators.evaluate import sweep_summary
from lexiloom.plans import sql
from lexiloom.plans.corpus_queries import (
    MARKED,
    PIECES,
    TURN_WINDOWS,
    byte_stream_sql,
    drawn_windows,
    learned_sql,
    turn_windows,
    written_turns,
)
from lexiloom.plans.evaluate import answer, token_alphabet
from lexiloom.plans.prepare import framed
from lexiloom.plans.train import CHAT_BLOCK, best_order, eval_log, measured_log
from lexiloom.session import stored
from lexiloom.sources.metadata import SPECIAL_TOKENS
from lexiloom.sources.pairs import chat_pairs
from lexiloom.sources.tables import spread, table

ORDERS = [1, 2, 3]
LOG_ORDERS = [1, 2, 3, 4]
ORDER = 2
TEMPERATURE = 0.7
BATCH = 8
INTERVAL = 5
FREE_BLOCK = 16
PROMPT_BLOCK = 448
PROBE_WINDOW = 64
PROMPT_MERGES = 64
PROMPT_TAIL = 63
# Orders whose contexts hold the sign between prompt and reply and the prompt's last bytes or tokens.
CHAT_ORDERS = [1, 2, 3, 4, 5]
TOKEN_ORDERS = [1, 2, 3, 4]
FEW_TOKENS = 12


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return spread(table(spark, directory, "documents").select("doc_id", "text"), "doc_id")


def _splits(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    split = split_tail(docs, "doc_id")
    return split.where(F.col("split") == "train"), split.where(F.col("split") == "val")


def ngram_counts(spark: SparkSession, directory: str) -> DataFrame:
    return count_ngrams(_documents(spark, directory), "text", ORDERS)


def ngram_weights(spark: SparkSession, directory: str) -> DataFrame:
    """The counts with every document weighing 1."""
    weights = count_ngrams(_documents(spark, directory), "text", [ORDER], weighting="example")
    return weights.withColumn("n", F.round("n", 6))


def _example_loss_query(order: int):
    def run(spark: SparkSession, directory: str) -> DataFrame:
        """Loss of each validation document under the model of the training documents."""
        train, val = _splits(_documents(spark, directory))
        losses = example_loss(val, "doc_id", "text", count_ngrams(train, "text", [order]), order)
        return losses.select("doc_id", F.round("loss", 6).alias("loss"))

    return run


def split_loss_query(spark: SparkSession, directory: str) -> DataFrame:
    train, val = _splits(_documents(spark, directory))
    counts = tally_ngrams(train, "text", [ORDER])
    on_val = split_loss(val, "text", counts.drop("w"), [ORDER]).withColumn("split", F.lit("val"))
    both = own_loss(counts).withColumn("split", F.lit("train")).unionByName(on_val)
    return both.select("split", "n_examples", F.round("loss", 6).alias("loss"))


def window_loss(spark: SparkSession, directory: str) -> DataFrame:
    """Loss of windows drawn from the stream of all documents; the first token is given."""
    docs = _documents(spark, directory)
    windows = drawn_windows(docs, PROBE_WINDOW, "loss")
    losses = example_loss(windows, "draw", "tokens", count_ngrams(docs, "text", [ORDER]), ORDER, BYTE_WINDOWS)
    return losses.select("draw", F.round("loss", 6).alias("loss"))


def token_window_loss(spark: SparkSession, directory: str) -> DataFrame:
    """Loss of windows read from the token file of all turns, under the model of the turns."""
    encoded, path, tokenizer = written_turns(spark, directory)
    alphabet = token_alphabet(tokenizer)
    counts = count_ngrams(encoded, "tokens", [ORDER], alphabet)
    windows = turn_windows(encoded, path)
    losses = example_loss(windows, "turn_id", "tokens", counts, ORDER, replace(alphabet, given=1))
    return losses.select("turn_id", F.round("loss", 6).alias("loss"))


def _drawn_losses(spark: SparkSession, directory: str) -> DataFrame:
    """Losses of as many documents drawn with replacement as there are."""
    docs = _documents(spark, directory)
    train, _ = _splits(docs)
    losses = example_loss(docs, "doc_id", "text", count_ngrams(train, "text", [ORDER]), ORDER)
    draws = docs.select(F.col("doc_id").alias("draw"))
    return draw_rows(draws, "draw", docs, "doc_id", "batch").join(losses, "doc_id")


def sampled_loss(spark: SparkSession, directory: str) -> DataFrame:
    return _drawn_losses(spark, directory).agg(
        F.count("*").alias("n_draws"), F.round(F.avg("loss"), 6).alias("loss")
    )


def _batches(spark: SparkSession, directory: str) -> DataFrame:
    losses = batch_loss(_drawn_losses(spark, directory), "draw", BATCH)
    return losses.select((F.col("batch_id") + 1).alias("step"), F.round("loss", 6).alias("loss"))


def batch_loss_query(spark: SparkSession, directory: str) -> DataFrame:
    return _batches(spark, directory)


def eval_steps_query(spark: SparkSession, directory: str) -> DataFrame:
    return eval_steps(_batches(spark, directory), INTERVAL)


def best_so_far(spark: SparkSession, directory: str) -> DataFrame:
    """The steps at which the smallest loss so far was undercut."""
    # the log is small, and its range, its running minima and its rows are all read from it
    log = stored(_batches(spark, directory), "log")
    return improvements(log, "loss").where("improved").select("step", "loss")


def best_step(spark: SparkSession, directory: str) -> DataFrame:
    return best_model(_batches(spark, directory), "loss")


def _log(spark: SparkSession, directory: str) -> DataFrame:
    log = eval_log(_documents(spark, directory), "doc_id", "text", LOG_ORDERS)
    return log.select(
        "model_order", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss")
    )


def train_throughput(spark: SparkSession, directory: str) -> DataFrame:
    """The log with what was observed while each order was counted; of the times, only that they were taken."""
    log = measured_log(_documents(spark, directory), "doc_id", "text", LOG_ORDERS)
    same = F.abs(F.col("targets_per_sec") * F.col("seconds") - F.col("n_targets")) < 1
    return log.select(
        "step", "n_examples", "n_targets", "n_entries", ((F.col("seconds") > 0) & same).alias("timed"),
        F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"),
    )


def best_model_query(spark: SparkSession, directory: str) -> DataFrame:
    return best_order(_log(spark, directory)).select("model_order", "val_loss")


def model_size_query(spark: SparkSession, directory: str) -> DataFrame:
    return model_size(count_ngrams(_documents(spark, directory), "text", ORDERS))


def softmax_temperature(spark: SparkSession, directory: str) -> DataFrame:
    counts = count_ngrams(_documents(spark, directory), "text", [ORDER])
    return with_temperature(counts, TEMPERATURE).select("context", "next", F.round("p", 6).alias("p"))


def cdf_draw_query(spark: SparkSession, directory: str) -> DataFrame:
    counts = count_ngrams(_documents(spark, directory), "text", ORDERS)
    return cdf_draw(counts).select("model_order", "context", "next")


def cdf_draw_tempered(spark: SparkSession, directory: str) -> DataFrame:
    counts = count_ngrams(_documents(spark, directory), "text", ORDERS)
    return cdf_draw(counts, TEMPERATURE).select("model_order", "context", "next")


def cdf_draw_weighted(spark: SparkSession, directory: str) -> DataFrame:
    """One draw per context, from a model in which every document weighs 1.

    Weights are rounded to 9 digits, so that the order in which a sum was formed moves no draw.
    """
    weights = count_ngrams(_documents(spark, directory), "text", [ORDER], weighting="example")
    return cdf_draw(weights.withColumn("n", F.round("n", 9))).select("model_order", "context", "next")


def _hex_output(generated: DataFrame, key: str) -> DataFrame:
    byte_hex = F.transform("out", lambda t: F.lpad(F.hex(t), 2, "0"))
    return generated.select(
        key, F.size("out").alias("n_generated"), F.array_join(byte_hex, "").alias("out_hex")
    )


def generate_free(spark: SparkSession, directory: str) -> DataFrame:
    """One text for each document id, from nothing."""
    docs = _documents(spark, directory)
    counts = count_ngrams(docs, "text", [1, 2])
    prompts = free_prompts(docs.select("doc_id"), "doc_id", FREE_BLOCK)
    return _hex_output(generate(prompts, "doc_id", counts, ORDER, FREE_BLOCK), "doc_id")


def generate_prompted(spark: SparkSession, directory: str) -> DataFrame:
    """Replies to all benchmark texts as chat prompts, from a model of the framed turns.

    The tags between prompt and reply are one byte, so the prompt's last bytes are in the reply's context.
    """
    pairs = chat_pairs(table(spark, directory, "conversations"))
    samples = pairs.select(close_turn(legacy_sample(F.col("input"), F.col("output"))).alias("text"))
    counts = count_ngrams(samples, "text", CHAT_ORDERS)
    prompts = byte_prompts(table(spark, directory, "benchmark"), "item_id", "text", PROMPT_BLOCK, closed=True)
    out = generate(
        prompts, "item_id", counts, CHAT_ORDERS[-1], PROMPT_BLOCK, temperature=TEMPERATURE, end_tag=END_TAG_BYTES
    )
    return _hex_output(out, "item_id")


def generate_order3(spark: SparkSession, directory: str) -> DataFrame:
    """The first tokens after all benchmark texts, from their last two bytes: a join per round."""
    counts = count_ngrams(_documents(spark, directory), "text", ORDERS)
    last = byte_ids(byte_tail(F.col("text"), PROMPT_TAIL))
    prompts = table(spark, directory, "benchmark").select(
        "item_id", last.alias("prompt"), F.lit(FEW_TOKENS).alias("budget")
    )
    out = generate(prompts, "item_id", counts, 3, FEW_TOKENS, temperature=TEMPERATURE)
    return _hex_output(out, "item_id")


def answer_prompts(spark: SparkSession, directory: str) -> DataFrame:
    """Replies to all user turns from a token model of the chat samples: frame, encode, continue, clean."""
    turns = table(spark, directory, "conversations")
    samples = framed(chat_pairs(turns)).select(close_turn(F.col("sample")).alias("sample"))
    tokenizer = learn(samples, "sample", len(SPECIAL_TOKENS) + 256 + PROMPT_MERGES)
    encoded = tokenizer.encode(samples, "sample")
    counts = count_ngrams(encoded, "tokens", TOKEN_ORDERS, token_alphabet(tokenizer))
    prompts = turns.where((F.col("role") == "user") & F.col("text").isNotNull())
    prompts = prompts.select(F.concat_ws("-", "conv_id", "turn").alias("prompt_id"), "text")
    return answer(prompts, "prompt_id", "text", tokenizer, counts, TOKEN_ORDERS[-1], block=2 * CHAT_BLOCK)


def sweep_query(spark: SparkSession, directory: str) -> DataFrame:
    """Validation losses by order and by whether the text is lowered."""
    losses = []
    for lowered in (False, True):
        docs = _documents(spark, directory)
        if lowered:
            docs = docs.withColumn("text", F.lower("text"))
        train, val = _splits(docs)
        loss = split_loss(val, "text", count_ngrams(train, "text", ORDERS), ORDERS)
        losses.append(loss.withColumn("lowered", F.lit(lowered)))
    both = losses[0].unionByName(losses[1])
    return sweep_summary(both, ["model_order", "lowered"]).withColumn("loss", F.round("loss", 6))


QUERIES = {
    "ngram_counts": ngram_counts,
    "ngram_weights": ngram_weights,
    "example_loss": _example_loss_query(2),
    "example_loss_order3": _example_loss_query(3),
    "split_loss": split_loss_query,
    "window_loss": window_loss,
    "token_window_loss": token_window_loss,
    "sampled_loss": sampled_loss,
    "batch_loss": batch_loss_query,
    "eval_steps": eval_steps_query,
    "best_so_far": best_so_far,
    "best_step": best_step,
    "eval_log": _log,
    "train_throughput": train_throughput,
    "best_model": best_model_query,
    "model_size": model_size_query,
    "softmax_temperature": softmax_temperature,
    "cdf_draw": cdf_draw_query,
    "generate_free": generate_free,
    "generate_prompted": generate_prompted,
    "generate_order3": generate_order3,
    "cdf_draw_tempered": cdf_draw_tempered,
    "cdf_draw_weighted": cdf_draw_weighted,
    "answer_prompts": answer_prompts,
    "sweep_summary": sweep_query,
}

_LOSS = "-ln(greatest(coalesce(n::DOUBLE / total::DOUBLE, 0), 1e-12::DOUBLE))"


def model_setup(orders: list[int], train: str = "split = 'train'", docs: str = sql.TAIL_SPLIT) -> str:
    """CTEs: the documents, their bytes with end marker, and per order the n-grams and the model."""
    parts = [
        f"docs AS MATERIALIZED (SELECT * FROM ({docs}))",
        f"byte_rows AS MATERIALIZED ({sql.byte_rows('docs', end=True)})",
    ]
    for k in orders:
        parts.append(f"grams{k} AS MATERIALIZED ({sql.grams(k)})")
        parts.append(
            f"model{k} AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY context)::BIGINT AS total FROM ("
            f"SELECT context, next, count(*) AS n FROM grams{k} JOIN docs USING (doc_id) WHERE {train} GROUP BY context, next))"
        )
    return "WITH RECURSIVE " + ",\n".join(parts)


def _losses(order: int) -> str:
    return (
        f"SELECT doc_id, avg({_LOSS}) AS loss FROM grams{order} LEFT JOIN model{order} USING (context, next) GROUP BY doc_id"
    )


_DRAWN = f"""
  {model_setup([ORDER])},
  losses AS ({_losses(ORDER)}),
  drawn AS (SELECT doc_id AS draw, {sql.draw('doc_id', '(SELECT count(*) FROM documents)', 'batch')} AS pos FROM documents),
  drawn_losses AS (SELECT draw, loss FROM drawn JOIN docs USING (pos) JOIN losses USING (doc_id)),
  batches AS (SELECT draw // {BATCH} + 1 AS step, round(avg(loss), 6) AS loss FROM drawn_losses GROUP BY 1)"""

LOG_SQL = model_setup(LOG_ORDERS) + " " + " UNION ALL ".join(
    f"""SELECT {k} AS model_order, round(avg(loss) FILTER (split = 'train'), 6) AS train_loss,
        round(avg(loss) FILTER (split = 'val'), 6) AS val_loss FROM ({_losses(k)}) JOIN docs USING (doc_id)"""
    for k in LOG_ORDERS
)


def _sweep() -> str:
    parts = []
    for lowered, text in (("false", "text"), ("true", "lower(text) AS text")):
        docs = sql.TAIL_SPLIT.replace("SELECT doc_id, text, pos,", f"SELECT doc_id, {text}, pos,", 1)
        for k in ORDERS:
            parts.append(
                f"SELECT {k} AS model_order, {lowered} AS lowered, (SELECT avg(loss) FROM "
                f"({model_setup([k], docs=docs)} SELECT loss FROM ({_losses(k)}) JOIN docs USING (doc_id) WHERE split = 'val')) AS loss"
            )
    return " UNION ALL ".join(parts)


def _tempered(n: str = "n") -> str:
    """Softmax of the logarithms of the counts over the temperature, not yet divided by its sum."""
    return f"exp((ln({n}::DOUBLE) - max(ln({n}::DOUBLE)) OVER (PARTITION BY context)) / {TEMPERATURE}::DOUBLE)"


def _walk(
    key: str,
    prompts: str,
    orders: list[int],
    kind: str = "DOUBLE",
    base: int = 257,
    stop: int = 256,
    piece: str = "upper(lpad(hex(next), 2, '0'))",
    tag: str | None = None,
    seed: str = "42",
) -> str:
    """Continue ``prompts(key, ids, budget)`` in the longest contexts seen, one token per recursion.

    ``ids`` packs the last ids, ``piece`` is what a token adds to the output ``done_out``.
    """
    last = orders[-1]
    at = f"{key} || ':' || step"
    place = sql.draw(at, "whole", seed) if kind == "BIGINT" else f"{sql.fraction(at, seed)} * whole"
    ended = f"right(o || {piece}, {len(tag)}) = '{tag}'" if tag else "false"
    models = " UNION ALL ".join(f"SELECT {k} AS k, context, next, n FROM model{k}" for k in orders)
    peak = "max(ln(n::DOUBLE)) OVER (PARTITION BY k, context)"
    weight = "n" if kind == "BIGINT" else f"exp((ln(n::DOUBLE) - {peak}) / {TEMPERATURE}::DOUBLE)"
    whole = ", ".join(f"t{k}.whole" for k in reversed(orders))
    found = " ".join(f"WHEN t{k}.whole IS NOT NULL THEN {k}" for k in reversed(orders))
    cut = " ".join(f"WHEN t{k}.whole IS NOT NULL THEN w.f % {base ** (k - 1)}" for k in reversed(orders))
    joins = " ".join(f"LEFT JOIN totals t{k} ON t{k}.k = {k} AND t{k}.context = w.f % {base ** (k - 1)}" for k in orders)
    return f"""
      weighted AS (SELECT k, context, next, {weight} AS w FROM ({models})),
      sums AS (SELECT k, context, next, sum(w) OVER (PARTITION BY k, context ORDER BY next)::{kind} AS hi FROM weighted),
      cdf AS MATERIALIZED (
        SELECT k, context, next, hi, coalesce(lag(hi) OVER (PARTITION BY k, context ORDER BY next), 0)::{kind} AS lo FROM sums),
      totals AS MATERIALIZED (SELECT k, context, max(hi) AS whole FROM cdf GROUP BY k, context),
      walk AS (
        SELECT {key}, 0 AS step, ids AS f, '' AS o, budget, budget <= 0 AS done FROM ({prompts}) p("{key}", ids, budget)
        UNION ALL
        SELECT {key}, step + 1, (f * {base} + next) % {base ** (last - 1)},
          CASE WHEN next = {stop} THEN o WHEN {ended} THEN left(o || {piece}, length(o || {piece}) - {len(tag or '')}) ELSE o || {piece} END,
          budget, next = {stop} OR {ended} OR step + 1 >= budget
        FROM (
          SELECT x.*, {place} AS u FROM (
            SELECT w.*, coalesce({whole}) AS whole, CASE {found} END AS k, CASE {cut} END AS context
            FROM walk w {joins} WHERE NOT done) x) y
        JOIN cdf ON cdf.k = y.k AND cdf.context = y.context AND lo <= u AND u < hi),
      walked AS (SELECT {key}, o AS done_out FROM walk WHERE done)"""


def _packed(hexes: str, order: int) -> str:
    """The last bytes of a hex text in base 257; 256 where there are none."""
    digit = lambda j: f"coalesce(try_cast('0x' || nullif(substr({hexes}, -{2 * j}, 2), '') AS BIGINT), 256)"
    known = lambda j: f"CASE WHEN length({hexes}) >= {2 * j} THEN {digit(j)} ELSE 256 END"
    return " + ".join(f"{known(j)} * {257 ** (j - 1)}" for j in range(1, order)) or "0"


_HEX_WALK = "SELECT {key}, length(done_out) // 2 AS n_generated, done_out AS out_hex FROM walked"


def _close(text: str) -> str:
    return f"regexp_replace({text}, ' ?<\\|assistant\\|> ?', chr(31), 'g')"


def _answers() -> str:
    """Replies to the user turns: merges learned on the samples, all texts encoded, the model walked, its output decoded."""
    specials = {t: i for i, t in enumerate(SPECIAL_TOKENS)}
    base, block = len(specials) + 256 + PROMPT_MERGES, 2 * CHAT_BLOCK
    closed = lambda x: f"replace({x}, '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10), '<|im_start|>')"
    prompt = (
        f"'<|im_start|>user' || chr(10) || {sql.strip('lower(' + sql.spaced('text') + ')')} || "
        "'<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
    )
    parts = "flatten(list_transform(string_split({marked}, chr(31)), lambda x: regexp_extract_all(x, {pieces})))"
    learn = parts.format(marked=MARKED, pieces=PIECES)
    encode = parts.format(marked=MARKED.replace("(text,", "(piece,"), pieces=PIECES)
    tags = "|".join(t.replace("|", "\\|") for t in specials)
    kinds = " ".join(f"WHEN '{t}' THEN {i}" for t, i in specials.items())
    before = f"""
      texts AS MATERIALIZED (
        SELECT 's' AS kind, conv_id || '-' || turn AS id, {closed(sql.im(sql.normalize('input'), sql.normalize('output')))} AS text FROM ({sql.PAIRS})
        UNION ALL SELECT 'p', conv_id || '-' || turn, {closed(prompt)} FROM conversations WHERE role = 'user' AND text IS NOT NULL),
      pieces AS MATERIALIZED (
        SELECT * FROM (SELECT kind, id, unnest(l) AS piece, unnest(range(len(l))) AS piece_no
          FROM (SELECT *, string_split(regexp_replace(text, '({tags})', chr(30) || '\\1' || chr(30), 'g'), chr(30)) AS l FROM texts))
        WHERE piece <> ''),
      placed AS MATERIALIZED (
        SELECT kind, id, piece_no, unnest(l) AS word, unnest(range(len(l))) AS word_no
        FROM (SELECT *, CASE WHEN regexp_full_match(piece, '{tags}') THEN [piece] ELSE {encode} END AS l FROM pieces)),"""
    words = f"""SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT unnest({learn}) AS word, 1 AS n FROM texts WHERE kind = 's' UNION ALL SELECT word, 0 FROM placed) GROUP BY word"""
    models = []
    for k in TOKEN_ORDERS:
        context = " + ".join(f"coalesce(lag(t, {j}) OVER w, 0)::BIGINT * {base ** (j - 1)}" for j in range(1, k)) or "0::BIGINT"
        window = "WINDOW w AS (PARTITION BY id ORDER BY token_no)" if k > 1 else ""
        models.append(
            f"model{k} AS MATERIALIZED (SELECT context, next, count(*) AS n FROM (SELECT {context} AS context, t AS next "
            f"FROM token_rows {window}) GROUP BY ALL)"
        )
    packed = " + ".join(f"coalesce(ids[len(ids) - {j - 1}], 0)::BIGINT * {base ** (j - 1)}" for j in range(1, TOKEN_ORDERS[-1]))
    prompts = f"""SELECT id, {packed}, least(64, {block} - least(len(ids), {block - 1}))
        FROM (SELECT id, list(t ORDER BY token_no) AS ids FROM tokens WHERE kind = 'p' GROUP BY id)"""
    more = "[89AB][0-9A-F]"
    whole = (
        f"[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F]){more}|E0[AB][0-9A-F]{more}|E[1-9A-CEF]{more}{more}|ED[89][0-9A-F]{more}"
        f"|F0[9AB][0-9A-F]{more}{more}|F[1-3]{more}{more}{more}|F48[0-9A-F]{more}{more}"
    )
    begun = (
        f"F0[9AB][0-9A-F]{more}|F[1-3]{more}{more}|F48[0-9A-F]{more}|E0[AB][0-9A-F]|E[1-9A-CEF]{more}|ED[89][0-9A-F]"
        f"|F0[9AB][0-9A-F]|F[1-3]{more}|F48[0-9A-F]|[0-9A-F][0-9A-F]"
    )
    return learned_sql(PROMPT_MERGES, words, before) + f""",
      final AS MATERIALIZED (SELECT word, s FROM learning WHERE step = {PROMPT_MERGES}),
      tokens AS MATERIALIZED (
        SELECT kind, id, t, row_number() OVER (PARTITION BY kind, id ORDER BY piece_no, word_no, char_no) AS token_no
        FROM (
          SELECT kind, id, piece_no, word_no, 0 AS char_no, CASE word {kinds} END AS t FROM placed WHERE word IN {tuple(specials)}
          UNION ALL
          SELECT kind, id, piece_no, word_no, unnest(range(1, length(s) + 1)), ord(s[unnest(range(1, length(s) + 1))]) - {bpe.SYMBOL_BASE}
          FROM placed JOIN final USING (word) WHERE word NOT IN {tuple(specials)})),
      token_rows AS MATERIALIZED (SELECT id, token_no, t FROM tokens WHERE kind = 's'),
      {", ".join(models)},
      {_walk("id", prompts, TOKEN_ORDERS, base=base, stop=specials['<|im_end|>'], piece=f"chr(({bpe.SYMBOL_BASE} + next)::INT)")},
      merged AS (SELECT DISTINCT step, pair FROM learning WHERE step > 0),
      unmerged AS (
        SELECT id, done_out AS s, {PROMPT_MERGES} AS step FROM walked
        UNION ALL
        SELECT id, replace(s, chr({bpe.SYMBOL_BASE + len(specials) + 255} + step), pair), step - 1 FROM unmerged JOIN merged USING (step)),
      spoken AS (
        SELECT id, array_to_string(list_transform(range(1, length(s) + 1), lambda i: coalesce(m[ord(s[i]) - {bpe.SYMBOL_BASE}], '')), '') AS h
        FROM unmerged, (SELECT map(list(id), list(h)) AS m FROM bytes) b WHERE step = 0),
      raw AS (
        SELECT id, decode(unhex(array_to_string(list_transform(regexp_extract_all(h, '{whole}|{begun}'),
          lambda x: CASE WHEN regexp_full_match(x, '{whole}') THEN x ELSE 'EFBFBD' END), ''))) AS t FROM spoken)
      SELECT id AS prompt_id,
        {sql.strip("split_part(replace(replace(t, '<|im_start|>', ' '), '<pad>', ' '), '<|im_end|>', 1)")} AS reply FROM raw"""


_FRAMED = f"hex(encode({_close("'<|user|> ' || " + sql.sanitize_ascii('text') + " || ' <|assistant|>'")}))"

ORACLE = {
    "ngram_counts": model_setup(ORDERS, "true") + " " + " UNION ALL ".join(
        f"SELECT {k} AS model_order, context, next, n FROM model{k}" for k in ORDERS
    ),
    "ngram_weights": model_setup([ORDER], "true") + f"""
      SELECT {ORDER} AS model_order, context, next, round(sum(1.0::DOUBLE / (octet_length(encode(text)) + 1)), 6) AS n
      FROM grams{ORDER} JOIN documents USING (doc_id) GROUP BY context, next""",
    "example_loss": model_setup([2]) + f"""
      SELECT doc_id, round(loss, 6) AS loss FROM ({_losses(2)}) JOIN docs USING (doc_id) WHERE split = 'val'""",
    "example_loss_order3": model_setup([3]) + f"""
      SELECT doc_id, round(loss, 6) AS loss FROM ({_losses(3)}) JOIN docs USING (doc_id) WHERE split = 'val'""",
    "split_loss": model_setup([ORDER]) + f"""
      SELECT split, count(*) AS n_examples, round(avg(loss), 6) AS loss
      FROM ({_losses(ORDER)}) JOIN docs USING (doc_id) GROUP BY split""",
    "window_loss": model_setup([2], "true") + f""",
      tokens AS (SELECT first_idx + pos AS idx, b FROM ({sql.byte_rows()}) JOIN ({byte_stream_sql()}) USING (doc_id)),
      sized AS (SELECT count(*) AS total, least({PROBE_WINDOW}, count(*) - 1) AS n FROM tokens),
      drawn AS (SELECT doc_id AS draw, {sql.draw('doc_id', '(total - n)', 'loss')} AS start_idx, n FROM documents, sized),
      places AS (SELECT draw, start_idx + unnest(range(n + 1)) AS idx FROM drawn),
      pairs AS (SELECT draw, lag(b) OVER (PARTITION BY draw ORDER BY idx) AS context, b AS next FROM places JOIN tokens USING (idx))
      SELECT draw, round(avg({_LOSS}), 6) AS loss FROM pairs LEFT JOIN model2 USING (context, next)
      WHERE context IS NOT NULL GROUP BY draw""",
    "token_window_loss": TURN_WINDOWS + f""",
      rows AS (SELECT coalesce(lag(t) OVER (PARTITION BY turn_id ORDER BY pos), 0) AS context, t AS next FROM stream),
      model AS (SELECT context, next, count(*) AS n, sum(count(*)) OVER (PARTITION BY context) AS total FROM rows GROUP BY context, next),
      pairs AS (SELECT turn_id, lag(t) OVER (PARTITION BY turn_id ORDER BY idx) AS context, t AS next FROM windows)
      SELECT turn_id, round(avg({_LOSS}), 6) AS loss FROM pairs LEFT JOIN model USING (context, next)
      WHERE context IS NOT NULL GROUP BY turn_id""",
    "sampled_loss": _DRAWN + " SELECT count(*) AS n_draws, round(avg(loss), 6) AS loss FROM drawn_losses",
    "batch_loss": _DRAWN + " SELECT step, loss FROM batches",
    "eval_steps": _DRAWN + f"""
      SELECT step, loss FROM batches WHERE step % {INTERVAL} = 0 OR step = (SELECT max(step) FROM batches)""",
    "best_so_far": _DRAWN + """
      SELECT step, loss FROM (SELECT *, min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM batches) WHERE before IS NULL OR loss < before""",
    "best_step": _DRAWN + " SELECT step, loss FROM batches ORDER BY loss, step LIMIT 1",
    "eval_log": LOG_SQL,
    "train_throughput": model_setup(LOG_ORDERS) + " " + " UNION ALL ".join(
        f"""SELECT {k} AS step, (SELECT count(*) FROM docs WHERE split = 'train') AS n_examples,
            (SELECT sum(n)::BIGINT FROM model{k}) AS n_targets, (SELECT count(*) FROM model{k}) AS n_entries, true AS timed,
            round(avg(loss) FILTER (split = 'train'), 6) AS train_loss, round(avg(loss) FILTER (split = 'val'), 6) AS val_loss
            FROM ({_losses(k)}) JOIN docs USING (doc_id)"""
        for k in LOG_ORDERS
    ),
    "best_model": f"SELECT model_order, val_loss FROM ({LOG_SQL}) ORDER BY val_loss, model_order LIMIT 1",
    "model_size": model_setup(ORDERS, "true") + " " + " UNION ALL ".join(
        f"""SELECT {k} AS model_order, count(*) AS n_entries, count(DISTINCT context) AS n_contexts,
            sum(n)::BIGINT AS n_targets FROM model{k}""" for k in ORDERS
    ),
    "softmax_temperature": model_setup([ORDER], "true") + f""",
      logits AS (SELECT context, next, ln(n::DOUBLE / total::DOUBLE) / {TEMPERATURE}::DOUBLE AS l FROM model{ORDER}),
      exps AS (SELECT context, next, exp(l - max(l) OVER (PARTITION BY context)) AS e FROM logits)
      SELECT context, next, round(e / sum(e) OVER (PARTITION BY context), 6) AS p FROM exps""",
    "cdf_draw": model_setup(ORDERS, "true") + " " + " UNION ALL ".join(
        f"""SELECT {k} AS model_order, context, next FROM (
              SELECT *, sum(n) OVER (PARTITION BY context ORDER BY next) AS hi,
                {sql.draw("context", 'total')} AS u FROM model{k})
            WHERE hi - n <= u AND u < hi""" for k in ORDERS
    ),
    "generate_free": model_setup([1, 2], "true") + "," + _walk(
        "doc_id", f"SELECT doc_id, 256::BIGINT, {FREE_BLOCK} FROM documents", [1, 2], "BIGINT"
    ) + _HEX_WALK.format(key="doc_id"),
    "generate_prompted": model_setup(
        CHAT_ORDERS,
        "true",
        f"SELECT conv_id || '-' || turn AS doc_id, {_close(sql.legacy('input', 'output'))} AS text FROM ({sql.PAIRS})",
    ) + "," + _walk(
        "item_id",
        f"""SELECT item_id, ({_packed('f', CHAT_ORDERS[-1])})::BIGINT, {PROMPT_BLOCK - 1} - length(f) // 2
            FROM (SELECT item_id, right({_FRAMED}, {2 * (PROMPT_BLOCK - 1)}) AS f FROM benchmark)""",
        CHAT_ORDERS,
        tag=bytes(END_TAG_BYTES).hex().upper(),
    ) + _HEX_WALK.format(key="item_id"),
    "generate_order3": model_setup(ORDERS, "true") + "," + _walk(
        "item_id",
        f"SELECT item_id, ({_packed('f', 3)})::BIGINT, {FEW_TOKENS} FROM (SELECT item_id, hex(encode(text)) AS f FROM benchmark)",
        ORDERS,
    ) + _HEX_WALK.format(key="item_id"),
    "answer_prompts": _answers(),
    "cdf_draw_tempered": model_setup(ORDERS, "true") + " " + " UNION ALL ".join(
        f"""SELECT {k} AS model_order, context, next FROM (
              SELECT context, next, hi, coalesce(lag(hi) OVER (PARTITION BY context ORDER BY next), 0) AS lo,
                {sql.fraction("context")} * max(hi) OVER (PARTITION BY context) AS u
              FROM (SELECT context, next, sum(w) OVER (PARTITION BY context ORDER BY next) AS hi
                    FROM (SELECT context, next, {_tempered()} AS w FROM model{k})))
            WHERE lo <= u AND u < hi""" for k in ORDERS
    ),
    "cdf_draw_weighted": model_setup([ORDER], "true") + f""",
      sums AS (SELECT context, next, sum(n) OVER (PARTITION BY context ORDER BY next) AS hi FROM (
        SELECT context, next, round(sum(1.0::DOUBLE / (octet_length(encode(text)) + 1)), 9) AS n
        FROM grams{ORDER} JOIN docs USING (doc_id) GROUP BY context, next)),
      cdf AS (SELECT context, next, hi, coalesce(lag(hi) OVER (PARTITION BY context ORDER BY next), 0) AS lo,
              {sql.fraction("context")} * max(hi) OVER (PARTITION BY context) AS u FROM sums)
      SELECT {ORDER} AS model_order, context, next FROM cdf WHERE lo <= u AND u < hi""",
    "sweep_summary": f"""
      SELECT model_order, lowered, count(*) AS n, round(avg(loss), 6) AS loss FROM ({_sweep()})
      GROUP BY GROUPING SETS ((model_order, lowered), (model_order), (lowered), ())""",
}
