"""The metadata document that goes with a pair of token files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.chat import IM_END, IM_START, PAD

# Ids of the special tokens, which every learned vocabulary starts with.
SPECIAL_TOKENS = [PAD, IM_START, IM_END]
U16_LIMIT = 65536


def storage_type(vocab_size: Column) -> Column:
    return F.when(vocab_size < U16_LIMIT, "u16").otherwise("u32")


def meta_document(
    stats: DataFrame, name: Column, key: list[str] | None = None, **extra: Column
) -> DataFrame:
    """JSON text per row of ``stats(train_samples, eval_samples, vocab_size)``."""
    specials = F.struct(
        *[F.lit(SPECIAL_TOKENS.index(t)).alias(k)
          for k, t in (("pad_id", PAD), ("im_start_id", IM_START), ("im_end_id", IM_END))]
    )
    fields = [
        name.alias("name"),
        (F.col("train_samples") + F.col("eval_samples")).alias("samples"),
        F.col("train_samples"),
        F.col("eval_samples"),
        F.col("vocab_size"),
        storage_type(F.col("vocab_size")).alias("dtype"),
        specials.alias("special_tokens"),
        F.lit("tokenizer").alias("tokenizer_path"),
        *[value.alias(k) for k, value in extra.items()],
    ]
    return stats.select(*(key or []), F.to_json(F.struct(*fields)).alias("meta"))


def int_field(text: Column, key: str, fallback: Column | int) -> Column:
    """The number after the first ``"key":`` anywhere in the text; 0 if no number follows."""
    pattern = rf'(?s)"\Q{key}\E"[^:]*:\s*([+-]?[0-9]+)?'
    digits = F.regexp_extract(text, pattern, 1)
    fallback = F.lit(fallback) if isinstance(fallback, int) else fallback
    return (
        F.when(~F.regexp_like(text, F.lit(pattern)), fallback)
        .when(digits == "", F.lit(0))
        .otherwise(digits.try_cast("int"))
    )


def string_field(text: Column, key: str) -> Column:
    """The quoted text after the first ``"key":``; NULL if there is none."""
    pattern = rf'(?s)"\Q{key}\E"[^:]*:[^"]*"([^"]*)"'
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def meta_fields(text: Column) -> Column:
    """STRUCT of the fields a token corpus needs, with the documented fallbacks."""
    return F.struct(
        string_field(text, "dtype").alias("dtype"),
        int_field(text, "vocab_size", -1).alias("vocab_size"),
        int_field(text, "pad_id", 0).alias("pad_id"),
        int_field(text, "user_id", int_field(text, "im_start_id", -1)).alias("user_id"),
        int_field(text, "assistant_id", -1).alias("assistant_id"),
        int_field(text, "end_id", int_field(text, "im_end_id", -1)).alias("end_id"),
    )
