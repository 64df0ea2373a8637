"""Pieces of the SQL equivalents, for an engine that knows nothing of this package."""

from __future__ import annotations

SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
STRIP = "' ' || " + " || ".join(
    f"chr({c})"
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def strip(x: str) -> str:
    return f"trim({x}, {STRIP})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def normalize(x: str) -> str:
    return f"lower({collapse(x)})"


def spaced(x: str) -> str:
    return f"translate({x}, chr(10) || chr(13) || chr(9), '   ')"


def sanitize_ascii(x: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"translate({x}, chr(10) || chr(13) || chr(9) || '{upper}', '   {upper.lower()}')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def draw(key: str, below: str, seed: int | str = 42) -> str:
    """An integer in [0, below) from the hash of the seed and the key."""
    digest = f"md5('{seed}:' || {key})"
    return (
        f"(CASE WHEN {below} <= {1 << 24} THEN ('0x' || substr({digest}, 1, 8))::BIGINT "
        f"ELSE ('0x' || substr({digest}, 1, 15))::BIGINT END % ({below})::BIGINT)"
    )


def fraction(key: str, seed: int | str = 42) -> str:
    """A DOUBLE in [0, 1) from 52 bits of the hash of the seed and the key."""
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE)"


def hexes(x: str) -> str:
    return f"regexp_extract_all(hex(encode({x})), '..')"


PAIRS = """
  SELECT conv_id, turn, text AS input, reply AS output FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'"""


def legacy(user: str, assistant: str) -> str:
    return f"('<|user|> ' || {user} || ' <|assistant|> ' || {assistant} || ' <|end|>')"


def im(user: str, assistant: str) -> str:
    return (
        f"('<|im_start|>user' || chr(10) || {user} || '<|im_end|>' || chr(10) || "
        f"'<|im_start|>assistant' || chr(10) || {assistant} || '<|im_end|>')"
    )


def byte_rows(source: str = "documents", key: str = "doc_id", end: bool = False) -> str:
    """(key, pos, b): the bytes of ``text``; with ``end``, 256 follows each row's last byte."""
    rows = (
        f"SELECT {key}, unnest(range(len(l)))::BIGINT AS pos, ('0x' || unnest(l))::INT AS b "
        f"FROM (SELECT {key}, {hexes('text')} AS l FROM {source})"
    )
    if end:
        rows += f" UNION ALL SELECT {key}, octet_length(encode(text)), 256 FROM {source}"
    return rows


def grams(order: int, rows: str = "byte_rows", key: str = "doc_id") -> str:
    """(key, context, next): each target with the ids before it, packed in base 257."""
    parts = [
        f"coalesce(lag(b, {j}) OVER w, 256)::BIGINT * {257 ** (j - 1)}" for j in range(1, order)
    ] or ["0::BIGINT"]
    window = f" WINDOW w AS (PARTITION BY {key} ORDER BY pos)" if order > 1 else ""
    return f"SELECT {key}, {' + '.join(parts)} AS context, b AS next FROM {rows}{window}"


SHUFFLED = """
  SELECT doc_id, text, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos,
         count(*) OVER () AS n_docs
  FROM documents"""

TAIL_SPLIT = f"""
  SELECT doc_id, text, pos,
         CASE WHEN pos < n_docs - CASE WHEN n_docs <= 1 THEN 0 ELSE greatest(1, n_docs // 10) END
              THEN 'train' ELSE 'val' END AS split
  FROM ({SHUFFLED})"""
