"""What is written and read again: tokenizers, models, logs and samples; also chosen splits and the sample cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.bpe import SPECIAL_TOKENS, SYMBOL_BASE, Tokenizer, learn
from lexiloom.operators.ngram import BYTES, count_ngrams
from lexiloom.operators.order import shuffled, split_head
from lexiloom.plans import sql
from lexiloom.plans.corpus_queries import EVAL_RATIO, FEW_MERGES, learned_sql
from lexiloom.plans.model_queries import LOG_ORDERS, LOG_SQL, model_setup
from lexiloom.plans.prepare import framed
from lexiloom.plans.train import eval_log
from lexiloom.session import new_path, stored
from lexiloom.sources.logs import EVALUATIONS, append_steps, read_log, read_steps, write_log
from lexiloom.sources.model_store import append_model, load_model, save_model
from lexiloom.sources.pairs import chat_pairs, choose_splits
from lexiloom.sources.samples import read_samples, write_samples
from lexiloom.sources.tables import table

ORDER = 2
CAP = 100
RATE = 1e-3


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", "text")


def tokenizer_store(spark: SparkSession, directory: str) -> DataFrame:
    """The merges of a tokenizer that was saved and loaded."""
    path = new_path(spark, "tokenizer")
    turns = table(spark, directory, "conversations").select("text")
    learn(turns, "text", len(SPECIAL_TOKENS) + 256 + FEW_MERGES).save(spark, path)
    return Tokenizer.load(spark, path).merges_table(spark)


def model_store(spark: SparkSession, directory: str) -> DataFrame:
    """A model that was saved and loaded, once with its own configuration; any other one is refused."""
    path = new_path(spark, "model")
    config = {"model_order": ORDER, "base": BYTES.base, "pad": BYTES.pad, "end": BYTES.end, "vocab_size": 257}
    save_model(count_ngrams(_documents(spark, directory), "text", [ORDER]), config, path)
    refused = 0
    for field, value in (("model_order", ORDER + 1), ("vocab_size", 258), ("weighting", "example")):
        try:
            load_model(spark, path, {**config, field: value})
        except ValueError:
            refused += 1
    return load_model(spark, path, config).withColumn("refused", F.lit(refused))


def model_append(spark: SparkSession, directory: str) -> DataFrame:
    """A model of one half of the documents that was saved, to which the counts of the other half were added."""
    path = new_path(spark, "model")
    docs = _documents(spark, directory)
    config = {"model_order": ORDER, "base": BYTES.base, "pad": BYTES.pad, "end": BYTES.end, "vocab_size": 257}
    save_model(count_ngrams(docs.where("doc_id % 2 = 0"), "text", [ORDER]), config, path)
    append_model(count_ngrams(docs.where("doc_id % 2 = 1"), "text", [ORDER]), config, path)
    return load_model(spark, path, config)


def log_resume(spark: SparkSession, directory: str) -> DataFrame:
    """A log whose run broke off after step 3, without validation losses, and was resumed from step 2 on."""
    path = new_path(spark, "log")
    log = eval_log(_documents(spark, directory), "doc_id", "text", LOG_ORDERS)
    log = stored(log.select(F.col("model_order").alias("step"), "train_loss", "val_loss", F.lit(RATE).alias("lr")), "log")
    broken = log.where("step <= 3").withColumn("val_loss", F.lit(None).cast("double"))
    append_steps(broken, path, "documents", EVALUATIONS)
    append_steps(log.where("step >= 2"), path, "documents", EVALUATIONS)
    return read_steps(spark, path, EVALUATIONS).select(
        "run", "step", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"), "lr"
    )


def log_store(spark: SparkSession, directory: str) -> DataFrame:
    """The evaluation log, written as CSV step by step and read back."""
    path = new_path(spark, "log")
    log = eval_log(_documents(spark, directory), "doc_id", "text", LOG_ORDERS).select(
        F.col("model_order").alias("step"), "train_loss", "val_loss", F.lit(RATE).alias("lr")
    )
    # each write below would learn the models again
    log = stored(log, "log")
    write_log(log.where(F.col("step") <= 2), path)
    write_log(log.where(F.col("step") > 2), path)
    read = read_log(spark, path, EVALUATIONS)
    return read.select(
        "step", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"), "lr"
    )


def _framed(spark: SparkSession, directory: str) -> DataFrame:
    samples = framed(chat_pairs(table(spark, directory, "conversations")))
    return samples.select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), "sample")


def samples_parquet(spark: SparkSession, directory: str) -> DataFrame:
    """Framed samples with key and split, written and read back."""
    path = new_path(spark, "samples")
    write_samples(split_head(_framed(spark, directory), "sample_id", EVAL_RATIO), path, form="parquet")
    read = read_samples(spark, path, form="parquet")
    return read.select("sample_id", "split", F.md5("sample").alias("sample_md5"))


def chosen_splits(spark: SparkSession, directory: str) -> DataFrame:
    """Splits given by the conversation: the test rows are the evaluation rows, the validation rows go."""
    split = F.element_at(F.array(F.lit("train"), F.lit("test"), F.lit("validation")), (F.col("conv_id") % 3 + 1).cast("int"))
    pairs = chat_pairs(table(spark, directory, "conversations")).withColumn("split", split)
    return choose_splits(pairs).select("conv_id", "turn", "split")


def sample_cap(spark: SparkSession, directory: str) -> DataFrame:
    """The first rows of the shuffle, the documented option that caps the number of samples."""
    return shuffled(_documents(spark, directory).select("doc_id"), "doc_id", limit=CAP).select("doc_id", "pos")


QUERIES = {
    "tokenizer_store": tokenizer_store,
    "model_store": model_store,
    "model_append": model_append,
    "log_store": log_store,
    "log_resume": log_resume,
    "samples_parquet": samples_parquet,
    "chosen_splits": chosen_splits,
    "sample_cap": sample_cap,
}

ORACLE = {
    "tokenizer_store": learned_sql(FEW_MERGES) + f"""
      SELECT DISTINCT step - 1 AS rank, ord(left(pair, 1)) - {SYMBOL_BASE} AS left_id,
        ord(right(pair, 1)) - {SYMBOL_BASE} AS right_id, {len(SPECIAL_TOKENS) + 255} + step AS new_id, pair_n AS n
      FROM learning WHERE step > 0""",
    "model_store": model_setup([ORDER], "true") + f"""
      SELECT {ORDER} AS model_order, context, next, n, 3 AS refused FROM model{ORDER}""",
    "model_append": model_setup([ORDER], "true") + f"""
      SELECT {ORDER} AS model_order, context, next, n FROM model{ORDER}""",
    "log_resume": f"""
      SELECT 'documents' AS run, model_order AS step, train_loss, CASE WHEN model_order >= 2 THEN val_loss END AS val_loss,
        {RATE!r}::DOUBLE AS lr FROM ({LOG_SQL})""",
    "log_store": f"SELECT model_order AS step, train_loss, val_loss, {RATE!r}::DOUBLE AS lr FROM ({LOG_SQL})",
    "samples_parquet": f"""
      WITH samples AS (
        SELECT conv_id || '-' || turn AS sample_id, md5({sql.im(sql.normalize('input'), sql.normalize('output'))}) AS sample_md5
        FROM ({sql.PAIRS})),
      placed AS (
        SELECT *, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) - 1 AS pos, count(*) OVER () AS n FROM samples)
      SELECT sample_id, CASE WHEN pos < greatest(1, floor(n * {EVAL_RATIO}::DOUBLE)) THEN 'eval' ELSE 'train' END AS split, sample_md5
      FROM placed""",
    "chosen_splits": f"""
      SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'train' ELSE 'eval' END AS split
      FROM ({sql.PAIRS}) WHERE conv_id % 3 < 2""",
    "sample_cap": f"""
      SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos FROM documents
      ORDER BY pos LIMIT {CAP}""",
}
