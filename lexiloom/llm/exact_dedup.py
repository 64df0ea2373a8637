"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is normalised (each run of white space becomes one space) and cut into chunks whose ends depend on
their content. A chunk's identifier is a hash; the distinct chunks of the whole corpus are compared once to
verify that no two of them share an identifier, else all identifiers are widened and verified anew. Two
documents are equal exactly when their ordered identifier lists (recipes) are, so after the chunks, only
recipes move: a long document is never sorted, grouped or joined by its text.

Defined results: null counts as empty, and all empty texts are equal; rows that share id and text are marked
alike, and dropping leaves one of them; null ids come after all others, so in a group of null ids only, all rows
are marked as kept, and dropping leaves one; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import stored, text_or_empty

#: A chunk ends at the first place of this kind past 64 characters, about one word end in fifty, or at 4,096
#: characters. Rare ends make the chunks of shifted texts fall into step again.
CHUNK = r"(?s).{64,4096}?(?:[a-e0-2аеио][n-t3-5нст] (?=[a-e0-2а-л])|[。、，])|.{1,4096}"
SPACES = r"[\x20\x09-\x0D]+"
#: Most identifier words per chunk; every word adds 64 bits.
MOST_WORDS = 8


def hash_word(chunk: Column, number: int) -> Column:
    """Word ``number`` of a chunk's identifier."""
    return F.xxhash64(F.lit(number), chunk)


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACES, " ")


def clashes(chunks: DataFrame) -> DataFrame:
    """Identifiers that different chunks share, of (identifier, chunk)."""
    return chunks.distinct().groupBy("identifier").count().where("count > 1")


def recipes(
    df: DataFrame, id_col: str, text_col: str, word: Callable[[Column, int], Column] = hash_word
) -> DataFrame:
    """(doc_id, text_sha256, recipe): the verified chunk identifiers of each document, in order."""
    text = normalised(text_col)
    texts = df.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    cut = texts.select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)).alias("chunks"),
    )
    # texts are cut once; verifying and listing both read the chunks
    cut = stored(cut, "chunks")
    chunks = F.col("chunks")
    words = 2
    while True:
        identifier = lambda chunk: F.array(*[word(chunk, i) for i in range(words)])  # noqa: E731, B023
        found = cut.select(F.explode(chunks).alias("chunk")).select(identifier(F.col("chunk")).alias("identifier"), "chunk")
        if clashes(found).isEmpty():
            break
        if words == MOST_WORDS:
            raise ValueError("chunk identifiers clash at every width")
        words += 1
    return cut.select(
        "doc_id",
        "text_sha256",
        F.flatten(F.transform(chunks, identifier)).alias("recipe"),
    )


def mark_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    word: Callable[[Column, int], Column] = hash_word,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row.

    Group sizes are counted before the shuffle; the join back is one that Spark can split at a hot recipe.
    """
    listed = stored(recipes(df, id_col, text_col, word), "recipes")
    groups = listed.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stored(groups, "recipe-groups")
    return listed.join(groups, "recipe").select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts: one of those of the smallest id; all its columns stay."""
    marked = stored(mark_copies(df, id_col, text_col).select(id_col, "text_sha256", "kept"), "marks")
    key = [F.col(id_col).alias("_copy_id"), F.col("text_sha256").alias("_copy_text")]
    digest = F.sha2(normalised(text_col).cast("binary"), 256)
    here = F.col(id_col).eqNullSafe(F.col("_copy_id")) & (digest == F.col("_copy_text"))
    left = df.join(marked.where(~F.col("kept")).select(*key).distinct(), here, "left_anti")
    # rows that share id and text: rare, and only they are moved to leave one of each
    again = marked.where("kept").groupBy(*key).agg(F.count("*").alias("_copies")).where("_copies > 1").drop("_copies")
    again = stored(again, "repeated-rows")
    if again.isEmpty():
        return left
    rows = left.withColumn("_copy_digest", digest).join(again, here, "left_semi")
    one = rows.dropDuplicates([id_col, "_copy_digest"]).drop("_copy_digest")
    return left.join(again, here, "left_anti").unionByName(one)
