"""Token-id array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tail_tokens(tokens: Column, size: int) -> Column:
    """The last ``size`` tokens."""
    return F.when(F.size(tokens) <= size, tokens).otherwise(F.slice(tokens, -size, size))


def parse_id_list(text: Column, vocab_size: int, max_ids: int | None = None) -> Column:
    """Ids separated by commas or blanks; NULL as soon as one of them is no id below ``vocab_size``."""
    if vocab_size <= 0:
        raise ValueError("vocab_size must be positive")
    parts = F.filter(F.split(text, "[, \t\r\n]+"), lambda p: p != "")
    ids = F.transform(
        parts, lambda p: F.when(p.rlike("^[+-]?[0-9]+$"), p.try_cast("bigint"))
    )
    valid = F.forall(ids, lambda v: F.coalesce(v.between(0, vocab_size - 1), F.lit(False)))
    if max_ids is not None:
        valid = valid & (F.size(ids) <= max_ids)
    return F.when(valid, ids.cast("array<int>"))


def next_token_arrays(tokens: Column) -> Column:
    """Inputs and targets of a token array, shifted by one."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.struct(
        F.slice(tokens, F.lit(1), pairs).alias("inputs"),
        F.slice(tokens, F.lit(2), pairs).alias("targets"),
    )


def join_ids(tokens: Column) -> Column:
    return F.array_join(tokens.cast("array<string>"), ",")
