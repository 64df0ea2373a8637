"""Prompts to replies to scores, all prompts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.chat import IM_END, clean_reply, close_turn, im_prompt
from lexiloom.operators.bpe import Tokenizer
from lexiloom.operators.evaluate import score_replies
from lexiloom.operators.generate import generate, token_prompts
from lexiloom.operators.ngram import Alphabet
from lexiloom.sources.metadata import SPECIAL_TOKENS


def token_alphabet(tokenizer: Tokenizer) -> Alphabet:
    """Token streams have no end marker; contexts are padded with the padding token."""
    return Alphabet(base=tokenizer.vocab_size, pad=0, end=None)


def answer(
    prompts: DataFrame,
    key: str,
    text: str,
    tokenizer: Tokenizer,
    counts: DataFrame,
    order: int,
    block: int = 128,
    max_new: int = 64,
    temperature: float = 0.7,
    seed: int = 42,
) -> DataFrame:
    """Frame, encode, continue, decode and clean: (``key``, reply).

    ``counts`` are of samples whose turns are closed (:func:`close_turn`), as the prompts' are here.
    """
    framed = prompts.select(key, close_turn(im_prompt(F.col(text))).alias("framed"))
    tokens = tokenizer.encode(framed, "framed")
    out = generate(
        token_prompts(tokens, key, "tokens", block, max_new),
        key,
        counts,
        order,
        min(max_new, block),
        token_alphabet(tokenizer),
        temperature,
        stop=SPECIAL_TOKENS.index(IM_END),
        seed=seed,
    )
    replies = tokenizer.decode(out, "out", "raw", skip_special=True)
    return replies.select(key, clean_reply(F.col("raw")).alias("reply"))


def evaluate(cases: DataFrame, tokenizer: Tokenizer, counts: DataFrame, order: int, **options) -> DataFrame:
    """Replies to the prompts of the case table, scored."""
    replies = answer(cases, "case_no", "prompt", tokenizer, counts, order, **options)
    return score_replies(replies, cases)
