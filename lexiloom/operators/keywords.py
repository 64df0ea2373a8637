"""Many keywords in one pass over the texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.shipping import ship

ship(__name__)

#: Keywords travel to every task, so their number is bounded.
MAX_KEYWORDS = 1 << 20


def find_keywords(
    docs: DataFrame, keywords: DataFrame, text: str = "text", keyword: str = "keyword", name: str = "hits"
) -> DataFrame:
    """Add the distinct keywords that occur anywhere inside the text, in code-point order; NULL for a NULL text.

    NULL and empty keywords are left out, repeated ones count once. One automaton finds all of them, so
    the time grows with the length of the texts and the number of hits, not with the number of keywords.
    """
    wanted = keywords.where(F.length(keyword) > 0).select(keyword).distinct().limit(MAX_KEYWORDS + 1)
    listed = sorted(row[0] for row in wanted.collect())
    if len(listed) > MAX_KEYWORDS:
        raise ValueError(f"more than {MAX_KEYWORDS} keywords")
    return docs.withColumn(name, _finder(docs, listed)(F.col(text)))


def _finder(docs: DataFrame, keywords: list[str]):
    sent = docs.sparkSession.sparkContext.broadcast(keywords)
    built: list[ahocorasick.Automaton] = []

    def automaton() -> ahocorasick.Automaton:
        if not built:
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for number, word in enumerate(sent.value):
                made.add_word(word, number)
            made.make_automaton()
            built.append(made)
        return built[0]

    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        words = sent.value
        if not words:
            return pa.array([None if t is None else [] for t in texts.to_pylist()], pa.list_(pa.string()))
        search = automaton()
        # keywords are numbered in their order
        found = (
            None if t is None else [words[i] for i in sorted({number for _, number in search.iter(t)})]
            for t in texts.to_pylist()
        )
        return pa.array(found, pa.list_(pa.string()))

    return find
