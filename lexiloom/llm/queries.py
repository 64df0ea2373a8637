"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import (
    exact_dedup,
    filter_audit,
    minhash,
    mixing,
    negatives,
    packing,
    pieces,
    pii,
    quality,
    sharding,
    suffix_dedup,
    topk,
    toxicity,
)
from lexiloom.sources.tables import table

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.mark_near_copies(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=16)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path(BYTE_VOCABULARY), longest=1024)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether decoding them gives the text back."""
    decoded = pieces.round_trip(documents(spark, sf_dir), vocabulary_path(PIECE_MODEL))
    text = F.coalesce("text", F.lit(""))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        "ids",
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        (F.col("decoded") == text).alias("round_trip"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the rows whose id is divisible by 7 are moved on by one, as noise."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine(vectors, F.col("id") % 50 == 0)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels")).drop("filter")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_minhash": op1_minhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_topk": op8_topk,
    "op9_packing": op9_packing,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_mixing": op12_mixing,
    "op13_filter_audit": op13_filter_audit,
}

_OP2 = r"""
WITH normal AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM normal
"""

_OP1 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id,
           list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id,
           CASE WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
           END AS s
    FROM words
),
shingles AS (SELECT doc_id, unnest(s) AS h FROM sets),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM shingles x JOIN shingles y ON x.h = y.h AND x.doc_id < y.doc_id
    GROUP BY ALL
),
near AS (
    SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
),
ties AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (
    SELECT a AS doc_id, a AS other FROM ties
    UNION
    SELECT r.doc_id, t.b FROM reach r JOIN ties t ON t.a = r.other
),
least AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN least l ON l.doc_id = s.doc_id
"""

_OP8 = """
WITH finite AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM finite q JOIN finite c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP11 = """
WITH finite AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
           CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
    FROM finite a JOIN finite c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT alike
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_OP12 = f"""
WITH sized AS (
    SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
           CAST('0x' || substr(md5(concat_ws(' ', '42', doc_id, text)), 1, 15) AS BIGINT) AS key
    FROM documents
),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS s,
           CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w
    FROM sized GROUP BY source
),
-- the clamped sources are the first by words per weight
sorted AS (
    SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS weight,
           coalesce(sum(3 * s) OVER e, 0) AS caps, coalesce(sum(w) OVER e, 0) AS gone
    FROM sources
    WINDOW e AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
clamps AS (SELECT *, 3 * s * (weight - gone) < w * (total - caps) AS clamped FROM sorted),
rest AS (
    SELECT CAST(max(total) - coalesce(sum(3 * s) FILTER (clamped), 0) AS BIGINT) AS words,
           CAST(max(weight) - coalesce(sum(w) FILTER (clamped), 0) AS BIGINT) AS weight
    FROM clamps
),
targets AS (
    SELECT source, s, CASE WHEN clamped THEN CAST(3 * s AS DOUBLE)
                           ELSE CAST(w * r.words AS DOUBLE) / CAST(greatest(r.weight, 1) AS DOUBLE) END AS target,
           CASE WHEN clamped THEN 3 * s ELSE (2 * w * r.words + r.weight) // (2 * greatest(r.weight, 1)) END AS goal
    FROM clamps, rest r
),
placed AS (
    SELECT d.*, s, target, CASE WHEN s > 0 THEN goal // s ELSE 0 END AS repeats,
           CASE WHEN s > 0 THEN goal % s ELSE 0 END AS extra,
           sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto,
           sum(size) OVER (PARTITION BY d.source, key) AS tied,
           count(*) FILTER (size > 0) OVER (PARTITION BY d.source, key) AS n
    FROM sized d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, s AS source_size, target,
       CAST(repeats * size + CASE WHEN upto <= extra THEN size WHEN upto - tied >= extra THEN 0
            ELSE least(size, (2 * (extra - (upto - tied)) + n) // (2 * n)) END AS BIGINT) AS taken
FROM placed
"""

_OP13 = f"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS words FROM documents
),
marks AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
    FROM labels GROUP BY doc_id
),
failures AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
    FROM texts LEFT JOIN marks USING (doc_id)
),
cells AS (SELECT part, good, toxic, mask, count(*) AS n FROM failures GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l(c, b)),
orders AS (
    SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.b | b.b | c.b | d.b | e.b = 31
),
steps AS (
    SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit,
           CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INTEGER) AS before
    FROM orders, range(1, 6) r(i)
),
counted AS (
    SELECT part, filter_order, step, bit,
           CAST(sum(n) FILTER (mask & (before | bit) = 0) AS BIGINT) AS kept,
           CAST(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS BIGINT) AS removed,
           CAST(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS BIGINT) AS redundant,
           CAST(sum(n) FILTER (mask = bit) AS BIGINT) AS unique_fails,
           CAST(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND good) AS BIGINT) AS good_lost,
           CAST(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND toxic) AS BIGINT) AS toxic_lost
    FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed,
       coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
       coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM counted
"""

ORACLE = {
    "op1_minhash": _OP1,
    "op2_exact_dedup": _OP2,
    "op8_topk": _OP8,
    "op11_hard_negatives": _OP11,
    "op12_mixing": _OP12,
    "op13_filter_audit": _OP13,
}
