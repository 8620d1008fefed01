"""The text functions in the SQL of the side-by-side check; each mirrors the one of the same name in functions.text."""

from __future__ import annotations

from ..functions import text as T


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g')"


def space(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[{T.SPACE}]+', ' ', 'g'), '^ | $', '', 'g')"


def normalize(c: str) -> str:
    return space(f"lower({c})")


def split(c: str) -> str:
    return f"(CASE WHEN {space(c)} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({space(c)}, ' ') END)"


def runs(c: str, pattern: str = r"[\p{L}\p{N}]+") -> str:
    return f"regexp_extract_all(lower({c}), '{pattern}')"


def bare(c: str, chars: str = T.EDGE_DASH, lower: bool = False) -> str:
    words = f"list_filter(list_transform({split(c)}, lambda w: trim(w, {quote(chars)})), lambda w: w <> '')"
    return f"list_transform({words}, lambda w: lower(w))" if lower else words


def pre_split(c: str) -> str:
    """Pieces before byte-pair merging. Without a look ahead, a sign (character 1) is set before white space that goes with what follows."""
    form = rf"('s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{T.SPACE}\p{{L}}\p{{N}}]+|[{T.SPACE}]+)".replace("'", "''")
    cut = rf"string_split(regexp_replace({c}, '([{T.SPACE}]+)([{T.SPACE}][^{T.SPACE}])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return f"flatten(list_transform({cut}, lambda s: regexp_extract_all(s, '{form}', 1)))"


def bucket(n: str) -> str:
    return f"(CASE WHEN {n} BETWEEN 20 AND 99 THEN 'short' WHEN {n} BETWEEN 100 AND 399 THEN 'medium' WHEN {n} BETWEEN 400 AND 1499 THEN 'long' WHEN {n} BETWEEN 1500 AND 8000 THEN 'very_long' END)"


def floor_title(c: str) -> str:
    return f"array_to_string(list_filter({split(c)}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))[1:5], ' ')"


def clean_title(c: str) -> str:
    thought = f"regexp_replace(regexp_replace(coalesce({c}, ''), '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*', '')"
    line = strip(f"regexp_replace({strip(thought)}, '(?s)[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}].*', '')")
    return strip(f"rtrim(trim({line}, {quote(T.QUOTES)}), {quote(T.ENDS)})")


def is_refusal(c: str) -> str:
    return "(" + " OR ".join(f"starts_with(lower({c}), {quote(p)})" for p in T.REFUSAL) + ")"


def hash_order(c: str, seed: int = 0) -> str:
    return f"md5('{seed}:' || CAST({c} AS VARCHAR))"


#: First user message of each conversation that begins with one.
FIRST = f"""SELECT conversation_hash, language, toxic, {strip("coalesce(conversation[1].content, '')")} AS text, ts
FROM source_conversations WHERE conversation[1].role = 'user'"""
