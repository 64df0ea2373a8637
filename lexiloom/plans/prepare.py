"""Pairs to samples to token files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.chat import im_sample
from lexiloom.functions.text import normalize
from lexiloom.operators.bpe import Tokenizer, learn
from lexiloom.operators.order import split_head
from lexiloom.operators.token_stream import token_stream, with_end_token
from lexiloom.session import new_path
from lexiloom.sources.metadata import U16_LIMIT, meta_document
from lexiloom.sources.samples import read_samples, write_samples
from lexiloom.sources.token_files import write_corpus


def framed(pairs: DataFrame) -> DataFrame:
    """Replace ``input`` and ``output`` by the ``im``-framed ``sample``."""
    sample = im_sample(normalize(F.col("input")), normalize(F.col("output")))
    return pairs.withColumn("sample", sample).drop("input", "output")


def encoded_streams(
    samples: DataFrame, key: str, tokenizer: Tokenizer, seed: int = 42, eos: int | None = None
) -> DataFrame:
    """(split, key, first_idx, last_idx, n_tokens, tokens), one stream per split.

    With ``eos``, that id ends each sample. Encoded samples are written once to the shared folder, since
    their lengths are needed before their places.
    """
    tokens = tokenizer.encode(samples, "sample")
    if eos is not None:
        tokens = with_end_token(tokens, "tokens", eos)
    path = new_path(samples.sparkSession, "encoded")
    tokens.select(key, "split", "tokens").write.parquet(path)
    tokens = samples.sparkSession.read.parquet(path)
    return token_stream(tokens, key, F.size("tokens"), seed=seed, by=("split",))


def prepare(
    samples: DataFrame,
    key: str,
    directory: str,
    name: str,
    vocab_size: int,
    eval_ratio: float = 0.05,
    seed: int = 42,
    eos: int | None = None,
) -> Tokenizer:
    """Learn a tokenizer on all samples; write the samples, both token files, the tokenizer and the metadata.

    ``samples(key, sample)`` is split by ``eval_ratio`` unless it has a ``split`` column already. The framed
    samples are kept as parquet with key and split, and all that follows reads them there.
    """
    spark = samples.sparkSession
    if "split" not in samples.columns:
        samples = split_head(samples, key, eval_ratio, seed)
    write_samples(samples.select(key, "split", "sample"), f"{directory}/samples", form="parquet")
    samples = read_samples(spark, f"{directory}/samples", form="parquet")
    tokenizer = learn(samples, "sample", vocab_size)
    streams = encoded_streams(samples, key, tokenizer, seed, eos)
    stats = samples.agg(
        F.count_if(F.col("split") == "train").alias("train_samples"),
        F.count_if(F.col("split") == "eval").alias("eval_samples"),
        F.lit(tokenizer.vocab_size).alias("vocab_size"),
    )
    dtype = "u16" if tokenizer.vocab_size < U16_LIMIT else "u32"
    write_corpus(streams, meta_document(stats, F.lit(name)), directory, dtype)
    tokenizer.save(spark, f"{directory}/tokenizer")
    return tokenizer
