"""Vocabularies, order, splits, token streams, examples, files and the generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.draws import draw
from lexiloom.functions.ids import join_ids
from lexiloom.functions.text import byte_ids, utf8
from lexiloom.operators import bpe, vocab
from lexiloom.operators.examples import doc_examples, explode_examples, next_token_counts
from lexiloom.operators.order import draw_rows, shuffled, split_head, split_tail
from lexiloom.operators.synth import PROMPTS, part_rows, prompt_rows, reply_rows, synth_chat
from lexiloom.operators.token_stream import sample_byte_windows, token_stream, window_draws, with_end_token
from lexiloom.plans import sql
from lexiloom.plans.prepare import framed
from lexiloom.session import new_path
from lexiloom.sources.metadata import meta_document, meta_fields
from lexiloom.sources.model_store import differing_fields
from lexiloom.sources.pairs import chat_pairs
from lexiloom.sources.samples import read_samples, write_samples
from lexiloom.sources.tables import spread, table
from lexiloom.sources.token_files import (
    append_tokens,
    corpus_stats,
    load_corpus,
    read_tokens,
    token_count,
    token_sums,
    token_windows,
    write_corpus,
    write_tokens,
)

WINDOW = 64
MERGES = 300
FEW_MERGES = 64
TOKEN_WINDOW = 32
EVAL_RATIO = 0.05
# small parts, so that the test tables too are written by several tasks
PART = 1 << 21
SUM_RANGE = 1000


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", "text")


def _spread_documents(spark: SparkSession, directory: str) -> DataFrame:
    return spread(_documents(spark, directory), "doc_id")


def _turns(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "conversations").select("conv_id", "turn", "text")


def _byte_tokens(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tokens", byte_ids(utf8(F.col("text")))).drop("text")


def _text_bytes(docs: DataFrame) -> DataFrame:
    """The bytes themselves, which are ids where they are written to a token file."""
    return docs.withColumn("tokens", utf8(F.col("text"))).drop("text")


# vocabulary


def byte_vocab(spark: SparkSession, directory: str) -> DataFrame:
    return vocab.byte_vocab(_spread_documents(spark, directory))


def byte_encode(spark: SparkSession, directory: str) -> DataFrame:
    docs = _spread_documents(spark, directory)
    encoded = vocab.encode_bytes(docs, vocab.byte_vocab(docs))
    return encoded.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(join_ids(F.col("tokens"))).alias("ids_md5")
    )


def byte_decode(spark: SparkSession, directory: str) -> DataFrame:
    docs = _spread_documents(spark, directory)
    ids = vocab.byte_vocab(docs)
    decoded = vocab.decode_bytes(vocab.encode_bytes(docs, ids), ids)
    return decoded.select("doc_id", F.md5("data").alias("text_md5"))


def unsupported_bytes(spark: SparkSession, directory: str) -> DataFrame:
    """Bytes of the documents that never occur in the conversations."""
    known = vocab.byte_vocab(spread(_turns(spark, directory), "conv_id", "turn"))
    return vocab.unsupported_bytes(_spread_documents(spark, directory), known, "doc_id")


def corpus_stats_query(spark: SparkSession, directory: str) -> DataFrame:
    return vocab.corpus_stats(split_tail(_spread_documents(spark, directory), "doc_id"))


# byte-pair encoding


def pretoken_counts(spark: SparkSession, directory: str) -> DataFrame:
    counts = bpe.pretoken_counts(_spread_documents(spark, directory))
    return counts.select(F.md5("word").alias("word_md5"), "n")


def bpe_pair_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Adjacent bytes inside pre-tokens: what the first merge is chosen from."""
    words = bpe.pretoken_counts(_spread_documents(spark, directory))
    symbols = words.select(bpe.word_symbols(F.col("word")).alias("word"), "n")
    alphabet = F.array(*[F.lit(f"{b:02X}") for b in bpe.byte_order()])
    first = len(bpe.SPECIAL_TOKENS)

    def spelled(char):
        return F.get(alphabet, F.ascii(char) - F.lit(bpe.SYMBOL_BASE + first))

    return bpe.pair_counts(symbols).select(
        spelled(F.left("pair", F.lit(1))).alias("left_hex"),
        spelled(F.right("pair", F.lit(1))).alias("right_hex"),
        "n",
    )


def _tokenizer(spark: SparkSession, directory: str, merges: int) -> bpe.Tokenizer:
    size = len(bpe.SPECIAL_TOKENS) + 256 + merges
    return bpe.learn(spread(_turns(spark, directory), "conv_id", "turn"), "text", size)


def bpe_merges(spark: SparkSession, directory: str) -> DataFrame:
    return _tokenizer(spark, directory, MERGES).merges_table(spark)


def bpe_encode(spark: SparkSession, directory: str) -> DataFrame:
    tokenizer = _tokenizer(spark, directory, FEW_MERGES)
    encoded = tokenizer.encode(spread(_turns(spark, directory), "conv_id", "turn"))
    return encoded.select(
        "conv_id", "turn", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(join_ids(F.col("tokens"))).alias("ids_md5")
    )


def bpe_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    """Documents encoded with merges learned on the conversations, and decoded again."""
    tokenizer = _tokenizer(spark, directory, FEW_MERGES)
    encoded = tokenizer.encode(_spread_documents(spark, directory)).drop("text")
    decoded = tokenizer.decode(encoded, skip_special=False)
    return decoded.select("doc_id", F.md5("text").alias("text_md5"))


# order, split and draws


def shuffle_order(spark: SparkSession, directory: str) -> DataFrame:
    return shuffled(_documents(spark, directory).select("doc_id"), "doc_id").select("doc_id", "pos")


def split_tail_query(spark: SparkSession, directory: str) -> DataFrame:
    return split_tail(_documents(spark, directory), "doc_id").select("doc_id", "split")


def split_head_query(spark: SparkSession, directory: str) -> DataFrame:
    return split_head(_documents(spark, directory), "doc_id", EVAL_RATIO).select("doc_id", "split")


def sample_docs(spark: SparkSession, directory: str) -> DataFrame:
    """As many draws with replacement as there are documents."""
    docs = _documents(spark, directory).select("doc_id")
    draws = docs.select(F.col("doc_id").alias("draw"))
    return draw_rows(draws, "draw", docs, "doc_id", "sample")


# token stream


def _stream_query(eos: bool):
    def run(spark: SparkSession, directory: str) -> DataFrame:
        docs = _documents(spark, directory).select("doc_id", F.octet_length("text").alias("bytes"))
        stream = token_stream(docs, "doc_id", F.col("bytes"), eos)
        return stream.select("doc_id", "first_idx", "last_idx", "n_tokens")

    return run


def drawn_windows(docs: DataFrame, window: int, seed: str) -> DataFrame:
    """One window per document, from the stream of all documents."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).scalar()
    sizes = docs.select("doc_id", F.octet_length("text").alias("size"))
    stream = token_stream(sizes, "doc_id", F.col("size")).select("doc_id", "first_idx", "last_idx")
    draws = window_draws(docs.select(F.col("doc_id").alias("draw")), "draw", total, window, seed)
    return sample_byte_windows(stream, docs, "doc_id", "text", draws, "draw")


def sample_windows_query(spark: SparkSession, directory: str) -> DataFrame:
    windows = drawn_windows(_spread_documents(spark, directory), WINDOW, "window")
    return windows.select("draw", "start_idx", "n", F.md5(join_ids(F.col("tokens"))).alias("ids_md5"))


def doc_examples_query(spark: SparkSession, directory: str) -> DataFrame:
    turns = spread(_turns(spark, directory), "conv_id", "turn")
    ids = vocab.byte_vocab(turns)
    marker = ids.agg(F.max("token_id").alias("bos")).scalar()
    encoded = vocab.encode_bytes(turns, ids).drop("text").withColumn("bos", marker)
    return explode_examples(doc_examples(encoded, "tokens", F.col("bos")).drop("bos"))


def next_token(spark: SparkSession, directory: str) -> DataFrame:
    """How often each byte follows each other byte within a conversation turn."""
    return next_token_counts(_byte_tokens(spread(_turns(spark, directory), "conv_id", "turn")))


# files and metadata


def _split_streams(spark: SparkSession, directory: str) -> DataFrame:
    docs = split_head(_spread_documents(spark, directory), "doc_id", EVAL_RATIO)
    return _text_bytes(token_stream(docs, "doc_id", F.octet_length("text"), by=("split",)))


def _split_meta(spark: SparkSession, directory: str) -> DataFrame:
    docs = split_head(_spread_documents(spark, directory), "doc_id", EVAL_RATIO)
    stats = docs.agg(
        F.count_if(F.col("split") == "train").alias("train_samples"),
        F.count_if(F.col("split") == "eval").alias("eval_samples"),
        F.lit(256).alias("vocab_size"),
    )
    return meta_document(stats, F.lit("documents"))


def token_file_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    """The stream of all documents, written, read back and summed up per 1,000 tokens.

    Offsets come from the byte lengths, so texts and not token arrays move; ids are made where they are written.
    """
    stream = token_stream(_spread_documents(spark, directory), "doc_id", F.octet_length("text"))
    return _written_sums(spark, _text_bytes(stream))


def token_file_eos(spark: SparkSession, directory: str) -> DataFrame:
    """As before, with an end token after each document, so that the stream has no gap."""
    stream = token_stream(_spread_documents(spark, directory), "doc_id", F.octet_length("text"), eos=True)
    return _written_sums(spark, with_end_token(_byte_tokens(stream), "tokens", 256))


def _written_sums(spark: SparkSession, stream: DataFrame) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(stream, path, tokens_per_part=PART)
    return token_sums(read_tokens(spark, path), SUM_RANGE)


def token_file_append(spark: SparkSession, directory: str) -> DataFrame:
    """A token file of one half of the documents, to which the other half is added: the sums of both versions."""
    path = new_path(spark, "tokens")
    docs = _spread_documents(spark, directory)
    halves = [docs.where(F.col("doc_id") % 2 == half) for half in (0, 1)]
    first, second = (_text_bytes(token_stream(d, "doc_id", F.octet_length("text"))) for d in halves)
    write_tokens(first, path, tokens_per_part=PART)
    added = append_tokens(second, path, tokens_per_part=PART)
    sums = [
        token_sums(read_tokens(spark, path, version=v), SUM_RANGE).withColumn("version", F.lit(v)) for v in (0, added)
    ]
    return sums[0].unionByName(sums[1])


def bpe_split_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Samples, tokens and bytes of both splits of the turns, in tokens learned on them."""
    turns = spread(_turns(spark, directory), "conv_id", "turn").withColumn("turn_id", F.concat_ws("-", "conv_id", "turn"))
    encoded = _tokenizer(spark, directory, FEW_MERGES).encode(split_head(turns, "turn_id", EVAL_RATIO))
    stats = vocab.encoded_stats(encoded, "split", "tokens", "text")
    return stats.withColumn("bytes_per_token", F.round("bytes_per_token", 6))


def written_turns(spark: SparkSession, directory: str) -> tuple[DataFrame, str, bpe.Tokenizer]:
    """All turns as BPE tokens (turn_id, tokens), and the path of the token file that they were written to."""
    tokenizer = _tokenizer(spark, directory, FEW_MERGES)
    turns = spread(_turns(spark, directory), "conv_id", "turn")
    encoded = tokenizer.encode(turns).select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "tokens")
    path = new_path(spark, "encoded")
    encoded.write.parquet(path)
    encoded = spark.read.parquet(path)
    written = new_path(spark, "turn-tokens")
    write_tokens(token_stream(encoded, "turn_id", F.size("tokens")), written, tokens_per_part=PART)
    return encoded, written, tokenizer


def turn_windows(encoded: DataFrame, path: str) -> DataFrame:
    """One window per turn, read from the token file."""
    total = F.lit(token_count(path)).cast("bigint")
    draws = window_draws(encoded.select("turn_id"), "turn_id", total, TOKEN_WINDOW, "windows")
    return token_windows(draws, "turn_id", path)


def token_windows_query(spark: SparkSession, directory: str) -> DataFrame:
    encoded, path, _ = written_turns(spark, directory)
    return turn_windows(encoded, path).select(
        "turn_id", "start_idx", "n", F.md5(join_ids(F.col("tokens"))).alias("ids_md5")
    )


def token_corpus_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Both splits written with their metadata, found again by the name of the training file."""
    path = new_path(spark, "corpus")
    streams, meta = _split_streams(spark, directory), _split_meta(spark, directory)
    write_corpus(streams, meta, path, tokens_per_part=PART)
    tokens, _ = load_corpus(spark, f"{path}/train.bin")
    return corpus_stats(tokens)


def samples_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    samples = framed(chat_pairs(table(spark, directory, "conversations")))
    path = new_path(spark, "samples")
    write_samples(samples, path)
    found = read_samples(spark, path)
    return found.groupBy(F.md5("sample").alias("sample_md5")).agg(F.count("*").alias("n"))


def _source_meta(spark: SparkSession, directory: str) -> DataFrame:
    """One metadata document per source, its documents split by the head of the shuffle."""
    docs = table(spark, directory, "documents").select("doc_id", "source", "text")
    docs = split_head(spread(docs, "doc_id"), "doc_id", EVAL_RATIO)
    sizes = vocab.byte_counts(docs, by="source").groupBy("source").agg(
        (F.count("*") + 1).cast("int").alias("vocab_size")
    )
    counts = docs.groupBy("source").agg(
        F.count_if(F.col("split") == "train").alias("train_samples"),
        F.count_if(F.col("split") == "eval").alias("eval_samples"),
    )
    return meta_document(counts.join(sizes, "source"), F.col("source"), ["source"])


def meta_document_query(spark: SparkSession, directory: str) -> DataFrame:
    return _source_meta(spark, directory)


def meta_fields_query(spark: SparkSession, directory: str) -> DataFrame:
    return _source_meta(spark, directory).select("source", meta_fields(F.col("meta")).alias("m")).select(
        "source", "m.*"
    )


def model_guard(spark: SparkSession, directory: str) -> DataFrame:
    """Which settings of a model learned on all documents differ from those of each source."""
    docs = spread(table(spark, directory, "documents").select("doc_id", "source", "text"), "doc_id")
    sizes = vocab.byte_counts(docs, by="source").groupBy("source").agg((F.count("*") + 1).alias("vocab_size"))
    whole = vocab.byte_counts(docs).agg((F.count("*") + 1).alias("n")).scalar()
    saved = F.struct(F.lit(2).alias("model_order"), F.col("whole").alias("vocab_size"), F.lit(42).alias("seed"))
    wanted = F.struct(F.lit(2).alias("model_order"), F.col("vocab_size"), F.lit(42).alias("seed"))
    differing = differing_fields(F.col("saved"), F.col("wanted"), ["model_order", "vocab_size", "seed"])
    return (
        sizes.withColumn("whole", whole)
        .select("source", "vocab_size", saved.alias("saved"), wanted.alias("wanted"))
        .select("source", "vocab_size", F.array_join(differing, ",").alias("differing"))
    )


# generator


def synth_query(spark: SparkSession, directory: str) -> DataFrame:
    """One sample per event."""
    ids = table(spark, directory, "events").select("event_id")
    return synth_chat(ids, "event_id").select("event_id", "topic", F.md5("sample").alias("sample_md5"))


def synth_topic_share(spark: SparkSession, directory: str) -> DataFrame:
    ids = table(spark, directory, "events").select("event_id")
    return synth_chat(ids, "event_id").groupBy("topic", "part").agg(F.count("*").alias("n"))


QUERIES = {
    "byte_vocab": byte_vocab,
    "byte_encode": byte_encode,
    "byte_decode": byte_decode,
    "unsupported_bytes": unsupported_bytes,
    "corpus_stats": corpus_stats_query,
    "pretoken_counts": pretoken_counts,
    "bpe_pair_counts": bpe_pair_counts,
    "bpe_merges": bpe_merges,
    "bpe_encode": bpe_encode,
    "bpe_roundtrip": bpe_roundtrip,
    "shuffle_order": shuffle_order,
    "split_tail": split_tail_query,
    "split_head": split_head_query,
    "sample_docs": sample_docs,
    "token_stream": _stream_query(eos=False),
    "token_stream_eos": _stream_query(eos=True),
    "sample_windows": sample_windows_query,
    "doc_examples": doc_examples_query,
    "next_token": next_token,
    "token_file_roundtrip": token_file_roundtrip,
    "token_file_eos": token_file_eos,
    "token_file_append": token_file_append,
    "bpe_split_stats": bpe_split_stats,
    "token_windows": token_windows_query,
    "token_corpus_stats": token_corpus_stats,
    "samples_roundtrip": samples_roundtrip,
    "meta_document": meta_document_query,
    "meta_fields": meta_fields_query,
    "model_guard": model_guard,
    "synth_chat": synth_query,
    "synth_topic_share": synth_topic_share,
}

_BYTES = sql.byte_rows()
_TURN_BYTES = sql.byte_rows("conversations", "conv_id, turn")
_VOCAB = "SELECT b, (row_number() OVER (ORDER BY b) - 1)::INT AS id FROM (SELECT DISTINCT b FROM bytes)"

# Look-ahead-free form of the split pattern: a mark before the last blank of each run that a
# non-blank follows stands in for the look-ahead.
_S = r"\t-\r\x{85}\p{Z}"
MARKED = f"regexp_replace(text, '([{_S}][^{_S}])', chr(31) || '\\1', 'g')"
PIECES = rf"'''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+'"
_WORDS = f"""
  SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(piece, {PIECES})) AS word
    FROM (SELECT unnest(string_split({MARKED}, chr(31))) AS piece FROM documents))
  GROUP BY word"""

_FIRST = len(bpe.SPECIAL_TOKENS)
_IDS = ", ".join(f"('{b:02X}', {i})" for i, b in enumerate(bpe.byte_order(), _FIRST))


def learned_sql(merges: int, words: str = "", before: str = "") -> str:
    """CTEs: ``learning`` holds the words after each merge, one at a time; by default those of the conversations."""
    words = words or _WORDS.replace("FROM documents", "FROM conversations")
    at = f"{bpe.SYMBOL_BASE} + {_FIRST + 256}"
    return f"""
      WITH RECURSIVE {before} bytes(h, id) AS (VALUES {_IDS}),
      spelled AS MATERIALIZED (
        SELECT word, n, string_agg(chr({bpe.SYMBOL_BASE} + id), '' ORDER BY pos) AS s
        FROM (SELECT word, n, unnest(l) AS h, unnest(range(len(l))) AS pos
              FROM (SELECT word, n, {sql.hexes('word')} AS l FROM ({words})))
        JOIN bytes USING (h) GROUP BY word, n),
      learning AS (
        SELECT 0 AS step, word, s, n, '' AS pair, 0::BIGINT AS pair_n FROM spelled
        UNION ALL
        SELECT step + 1, word, replace(s, top.pair, chr({at} + step)), n, top.pair, top.pair_n
        FROM learning, (
          SELECT pair, sum(n)::BIGINT AS pair_n
          FROM (SELECT unnest(list_transform(range(1, length(s)), lambda i: s[i:i + 1])) AS pair, n FROM learning WHERE length(s) > 1)
          GROUP BY pair HAVING sum(n) >= 2 ORDER BY pair_n DESC, pair LIMIT 1) top
        WHERE step < {merges})"""


_SYMBOLS = f"""
      pieces AS (SELECT conv_id, turn, unnest(l) AS piece, unnest(range(len(l))) AS piece_no
                 FROM (SELECT conv_id, turn, string_split({MARKED}, chr(31)) AS l FROM conversations)),
      placed AS (SELECT conv_id, turn, piece_no, unnest(l) AS word, unnest(range(len(l))) AS word_no
                 FROM (SELECT conv_id, turn, piece_no, regexp_extract_all(piece, {PIECES}) AS l FROM pieces)),
      symbols AS (SELECT conv_id, turn, piece_no, word_no, unnest(range(1, length(s) + 1)) AS char_no, s
                  FROM placed JOIN learning USING (word) WHERE step = {FEW_MERGES})"""

# The tokens of all turns in stream order, and those of one window per turn.
TURN_WINDOWS = learned_sql(FEW_MERGES) + f""",
      {_SYMBOLS},
      stream AS MATERIALIZED (
        SELECT turn_id, t, row_number() OVER (PARTITION BY turn_id ORDER BY piece_no, word_no, char_no) AS pos,
               row_number() OVER (ORDER BY md5('42:' || turn_id), turn_id, piece_no, word_no, char_no) - 1 AS idx
        FROM (SELECT conv_id || '-' || turn AS turn_id, piece_no, word_no, char_no, ord(s[char_no]) - {bpe.SYMBOL_BASE} AS t FROM symbols)),
      sized AS (SELECT count(*) AS total, least({TOKEN_WINDOW}, count(*) - 1) AS n FROM stream),
      drawn AS (SELECT conv_id || '-' || turn AS turn_id, {sql.draw("(conv_id || '-' || turn)", '(total - n)', 'windows')} AS start_idx, n
                FROM conversations, sized WHERE n > 0),
      places AS (SELECT turn_id, start_idx, n, start_idx + unnest(range(n + 1)) AS idx FROM drawn),
      windows AS (SELECT p.turn_id, start_idx, n, idx, t FROM places p JOIN stream USING (idx))"""

_STREAM = """
  SELECT doc_id, first_idx, first_idx + n_tokens - 1 AS last_idx, n_tokens FROM (
    SELECT doc_id, n_tokens, (sum(n_tokens) OVER (ORDER BY md5('42:' || doc_id), doc_id) - n_tokens)::BIGINT AS first_idx
    FROM (SELECT doc_id, {n} AS n_tokens FROM documents))"""
_BYTE_STREAM = _STREAM.format(n="octet_length(encode(text))")


def byte_stream_sql() -> str:
    """(doc_id, first_idx, last_idx, n_tokens) of the byte stream."""
    return _BYTE_STREAM


_HEAD = f"""
  SELECT doc_id, source, text, CASE WHEN pos < greatest(1, floor(n_docs * {EVAL_RATIO}::DOUBLE)) THEN 'eval' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n_docs FROM documents)"""

_SOURCE_STATS = f"""
  SELECT source, train_samples, eval_samples, vocab_size FROM
    (SELECT source, count(*) FILTER (split = 'train') AS train_samples, count(*) FILTER (split = 'eval') AS eval_samples
     FROM ({_HEAD}) GROUP BY source)
    JOIN (SELECT source, count(DISTINCT b) + 1 AS vocab_size
          FROM ({sql.byte_rows('documents', 'source, doc_id')}) GROUP BY source) USING (source)"""


def _values(rows: list[tuple], columns: str) -> str:
    def literal(v) -> str:
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"(VALUES {body}) t({columns})"


_UNITS = part_rows()[-1][1]
_SYNTH = f"""
  WITH parts AS (SELECT * FROM {_values(part_rows(), 'lo, hi, topic, part')}),
  prompts AS (SELECT * FROM {_values(prompt_rows(), 'part, pick, prompt')}),
  replies AS (SELECT *, count(*) OVER (PARTITION BY part) AS n_replies FROM {_values(reply_rows(), 'part, pick, reply')}),
  drawn AS (SELECT event_id, {sql.draw("'topic:' || event_id", str(_UNITS))} AS unit FROM events),
  placed AS (SELECT event_id, topic, part FROM drawn JOIN parts ON lo <= unit AND unit < hi)
  SELECT event_id, topic, placed.part, md5({sql.legacy('prompt', 'reply')}) AS sample_md5
  FROM placed JOIN prompts ON placed.part = prompts.part AND prompts.pick = {sql.draw("'prompts:' || event_id", str(len(PROMPTS)))}
  JOIN replies ON placed.part = replies.part AND replies.pick = {sql.draw("'replies:' || event_id", 'n_replies')}"""

ORACLE = {
    "byte_vocab": f"""
      WITH bytes AS ({_BYTES}), counts AS (SELECT b, count(*) AS n FROM bytes GROUP BY b)
      SELECT (row_number() OVER (ORDER BY b) - 1)::INT AS token_id, b AS byte, n FROM counts
      UNION ALL SELECT count(*)::INT, NULL, 0 FROM counts""",
    "byte_encode": f"""
      WITH bytes AS ({_BYTES}), ids AS ({_VOCAB})
      SELECT doc_id, count(*) AS n_tokens, md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS ids_md5
      FROM bytes JOIN ids USING (b) GROUP BY doc_id""",
    "byte_decode": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "unsupported_bytes": f"""
      SELECT DISTINCT doc_id, b AS byte FROM ({_BYTES}) WHERE b NOT IN (SELECT b FROM ({_TURN_BYTES}))""",
    "corpus_stats": f"""
      SELECT coalesce(split, 'all') AS split, count(*) AS n_docs, sum(octet_length(encode(text)))::BIGINT AS n_tokens,
        (SELECT count(DISTINCT b) + 1 FROM ({_BYTES})) AS vocab_size
      FROM ({sql.TAIL_SPLIT}) GROUP BY ROLLUP (split)""",
    "pretoken_counts": f"SELECT md5(word) AS word_md5, n FROM ({_WORDS})",
    "bpe_pair_counts": f"""
      WITH words AS (SELECT {sql.hexes('word')} AS l, n FROM ({_WORDS}))
      SELECT left_hex, right_hex, sum(n)::BIGINT AS n
      FROM (SELECT unnest(l[:-2]) AS left_hex, unnest(l[2:]) AS right_hex, n FROM words WHERE len(l) > 1)
      GROUP BY left_hex, right_hex""",
    "bpe_merges": learned_sql(MERGES) + f"""
      SELECT DISTINCT step - 1 AS rank, ord(left(pair, 1)) - {bpe.SYMBOL_BASE} AS left_id,
        ord(right(pair, 1)) - {bpe.SYMBOL_BASE} AS right_id, {_FIRST + 255} + step AS new_id, pair_n AS n
      FROM learning WHERE step > 0""",
    "bpe_encode": learned_sql(FEW_MERGES) + f""",
      {_SYMBOLS}
      SELECT conv_id, turn, count(*) AS n_tokens,
        md5(string_agg((ord(s[char_no]) - {bpe.SYMBOL_BASE})::VARCHAR, ',' ORDER BY piece_no, word_no, char_no)) AS ids_md5
      FROM symbols GROUP BY conv_id, turn""",
    "token_windows": TURN_WINDOWS + """
      SELECT turn_id, start_idx, n, md5(string_agg(t::VARCHAR, ',' ORDER BY idx)) AS ids_md5
      FROM windows GROUP BY turn_id, start_idx, n""",
    "bpe_roundtrip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "shuffle_order": "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos FROM documents",
    "split_tail": f"SELECT doc_id, split FROM ({sql.TAIL_SPLIT})",
    "split_head": f"SELECT doc_id, split FROM ({_HEAD})",
    "sample_docs": f"""
      WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos FROM documents),
      drawn AS (SELECT doc_id AS draw, {sql.draw('doc_id', '(SELECT count(*) FROM documents)', 'sample')} AS pos FROM documents)
      SELECT draw, doc_id FROM drawn JOIN placed USING (pos)""",
    "token_stream": _BYTE_STREAM,
    "token_stream_eos": _STREAM.format(n="octet_length(encode(text)) + 1"),
    "sample_windows": f"""
      WITH bytes AS ({_BYTES}), stream AS ({_BYTE_STREAM}),
      tokens AS (SELECT first_idx + pos AS idx, b FROM bytes JOIN stream USING (doc_id)),
      sized AS (SELECT count(*) AS total, least({WINDOW}, count(*) - 1) AS n FROM tokens),
      drawn AS (SELECT doc_id AS draw, {sql.draw('doc_id', '(total - n)', 'window')} AS start_idx, n FROM documents, sized),
      places AS (SELECT draw, start_idx, n, start_idx + unnest(range(n + 1)) AS idx FROM drawn)
      SELECT draw, start_idx, n, md5(string_agg(b::VARCHAR, ',' ORDER BY idx)) AS ids_md5
      FROM places JOIN tokens USING (idx) GROUP BY draw, start_idx, n""",
    "doc_examples": f"""
      WITH bytes AS ({_TURN_BYTES}), ids AS ({_VOCAB}), marker AS (SELECT count(*)::INT AS bos FROM ids),
      targets AS (
        SELECT conv_id, turn, pos, id FROM bytes JOIN ids USING (b)
        UNION ALL SELECT conv_id, turn, octet_length(encode(text)), bos FROM conversations, marker)
      SELECT conv_id, turn, pos::INT AS pos,
        coalesce(lag(id) OVER (PARTITION BY conv_id, turn ORDER BY pos), bos) AS input_id, id AS target_id
      FROM targets, marker""",
    "next_token": f"""
      SELECT token, next_token, count(*) AS n FROM (
        SELECT b AS token, lead(b) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS next_token FROM ({_TURN_BYTES}))
      WHERE next_token IS NOT NULL GROUP BY token, next_token""",
    "token_file_roundtrip": f"""
      WITH tokens AS (SELECT first_idx + pos AS idx, b FROM ({_BYTES}) JOIN ({_BYTE_STREAM}) USING (doc_id))
      SELECT idx // 1000 AS part, count(*) AS n, sum(b)::BIGINT AS token_sum, sum(b * (idx % 1000))::BIGINT AS weighted_sum
      FROM tokens GROUP BY idx // 1000""",
    "token_file_eos": f"""
      WITH sized AS (
        SELECT doc_id, sum(octet_length(encode(text)) + 1) OVER (ORDER BY md5('42:' || doc_id), doc_id) - octet_length(encode(text)) - 1 AS first_idx
        FROM documents),
      tokens AS (SELECT first_idx + pos AS idx, b FROM ({sql.byte_rows(end=True)}) JOIN sized USING (doc_id))
      SELECT (idx // 1000)::BIGINT AS part, count(*) AS n, sum(b)::BIGINT AS token_sum, sum(b * (idx % 1000))::BIGINT AS weighted_sum
      FROM tokens GROUP BY 1""",
    "token_file_append": f"""
      WITH sized AS (
        SELECT doc_id, doc_id % 2 AS half, octet_length(encode(text)) AS n, sum(n) OVER (ORDER BY doc_id % 2, md5('42:' || doc_id), doc_id) - n AS first_idx
        FROM documents),
      tokens AS (SELECT half, first_idx + pos AS idx, b FROM ({_BYTES}) JOIN sized USING (doc_id))
      SELECT version, (idx // {SUM_RANGE})::BIGINT AS part, count(*) AS n, sum(b)::BIGINT AS token_sum,
        sum(b * (idx % {SUM_RANGE}))::BIGINT AS weighted_sum
      FROM tokens, (VALUES (0), (1)) versions(version) WHERE half <= version GROUP BY 1, 2""",
    "bpe_split_stats": learned_sql(FEW_MERGES) + f""",
      {_SYMBOLS},
      sized AS (SELECT conv_id, turn, count(*) AS n FROM symbols GROUP BY conv_id, turn),
      placed_turns AS (
        SELECT conv_id, turn, text, row_number() OVER (ORDER BY md5('42:' || conv_id || '-' || turn), conv_id || '-' || turn) - 1 AS pos,
          count(*) OVER () AS n_turns FROM conversations),
      split_turns AS (
        SELECT n, octet_length(encode(text)) AS size,
          CASE WHEN pos < greatest(1, floor(n_turns * {EVAL_RATIO}::DOUBLE)) THEN 'eval' ELSE 'train' END AS split
        FROM placed_turns JOIN sized USING (conv_id, turn))
      SELECT split, count(*) AS n_samples, sum(n)::BIGINT AS n_tokens, min(n)::INT AS min_tokens, max(n)::INT AS max_tokens,
        sum(size)::BIGINT AS n_bytes, round(sum(size)::DOUBLE / sum(n)::DOUBLE, 6) AS bytes_per_token
      FROM split_turns GROUP BY split""",
    "token_corpus_stats": f"""
      SELECT split, count(*) AS n_tokens, min(b) AS min_token, max(b) AS max_token, sum(b)::BIGINT AS token_sum
      FROM ({_BYTES}) JOIN ({_HEAD}) USING (doc_id) GROUP BY split""",
    "samples_roundtrip": f"""
      SELECT md5({sql.im(sql.normalize('input'), sql.normalize('output'))}) AS sample_md5, count(*) AS n
      FROM ({sql.PAIRS}) GROUP BY 1""",
    "meta_document": f"""
      SELECT source, '{{"name":"' || source || '","samples":' || (train_samples + eval_samples) || ',"train_samples":' || train_samples
        || ',"eval_samples":' || eval_samples || ',"vocab_size":' || vocab_size || ',"dtype":"u16"'
        || ',"special_tokens":{{"pad_id":0,"im_start_id":1,"im_end_id":2}},"tokenizer_path":"tokenizer"}}' AS meta
      FROM ({_SOURCE_STATS})""",
    "meta_fields": f"""
      SELECT source, 'u16' AS dtype, vocab_size::INT AS vocab_size, 0 AS pad_id, 1 AS user_id, -1 AS assistant_id, 2 AS end_id
      FROM ({_SOURCE_STATS})""",
    "model_guard": f"""
      SELECT source, vocab_size, CASE WHEN vocab_size = (SELECT count(DISTINCT b) + 1 FROM ({_BYTES})) THEN '' ELSE 'vocab_size' END AS differing
      FROM ({_SOURCE_STATS})""",
    "synth_chat": f"SELECT event_id, topic, sample_md5 FROM ({_SYNTH})",
    "synth_topic_share": f"SELECT topic, part, count(*) AS n FROM ({_SYNTH}) GROUP BY topic, part",
}
