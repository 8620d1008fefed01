"""Copies hidden by formatting (problem 4).

A text that lists named fields is the multiset of its normalised name and value pairs: each pair is hashed and the
hashes are added up, so that order and layout don't matter and nothing is sorted. Any other text is one pair, of
no name and its words in their order. Records are grouped by the 128-bit sum, and each member is then compared with the record
that stands for the group, words with words and fields with fields.

Words are runs of letters and digits in lower case, and a field's name is up to three of them in 40 characters. A record whose words equal those of a field list in another
layout belongs to that list as well.

Defined results: null texts are left out; texts without words are one record, that of no words; repeated rows of an id
count once; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage, spread

_WORD = re.compile(r"[^\W_]+")
_PAIR = re.compile(r"\s*(?:[-*•–]\s*)?[\"'“]?([^\W\d_][\w .-]{0,39}?)[\"'”]?\s*[:=]\s*(.*?)\s*", re.S)
_MASK = (1 << 64) - 1
_TOP = 1 << 128


def words(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def _walk(value) -> str:
    if isinstance(value, dict):
        return " ".join(f"{k} {_walk(v)}" for k, v in value.items())
    return " ".join(map(_walk, value)) if isinstance(value, list) else "" if value is None else str(value)


def fields(text: str) -> list[tuple[str, str]] | None:
    """The (name, value) pairs of a text that is nothing but a list of two or more named fields, else None."""
    t = text.strip()
    if t[:1] == "{" and t[-1:] == "}":
        try:
            pairs = json.loads(t, object_pairs_hook=lambda kv: kv)
        except ValueError:
            pairs = None
        if isinstance(pairs, list) and len(pairs) > 1 and all(isinstance(p, tuple) for p in pairs):
            return [(words(k), words(_walk(v))) for k, v in pairs]
        t = t[1:-1]
    if ":" not in t and "=" not in t:
        return None
    for cut in ("\n", "|", ";", ",", "\t"):
        parts = [p for p in t.split(cut) if p.strip()]
        if len(parts) < 2:
            continue
        found = [_PAIR.fullmatch(p) for p in parts]
        # a name of up to three words; a value that is itself "name: value" means that this isn't the separator
        if all(m and len(m[1].split()) <= 3 and words(m[1]) and (m[2] and ":" not in m[2]) for m in found):
            return [(words(m[1]), words(m[2])) for m in found]
        if cut == "\n" and all(":" in p or "=" in p for p in parts):
            continue
    return None


def _print(pairs: list[tuple[str, str]]) -> int:
    return sum(xxhash.xxh3_128_intdigest(f"{k}\0{v}") for k, v in pairs) % _TOP


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _prints(messages: DataFrame, content: bool = False) -> DataFrame:
    """(id, word_hi, word_lo, field_hi, field_lo): the prints of each record; with ``content``, (id, word_hi, word_lo, content), what they were made of."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for t in b.column(1).to_pylist():
                w = words(t)
                f = fields(t)
                x = _print([("", w)])
                y = _print(f) if f and not content else None
                for c, v in zip(cols, (_signed(x >> 64), _signed(x & _MASK), None if y is None else _signed(y >> 64), None if y is None else _signed(y & _MASK), "\2".join(f"{k}\1{v}" for k, v in f) if f else w)):
                    c.append(v)
            made = {"word_hi": cols[0], "word_lo": cols[1]} | ({"content": cols[4]} if content else {"field_hi": cols[2], "field_lo": cols[3]})
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if k == "content" else pa.int64()) for k, c in made.items())], names=["id", *made])

    kind = messages.schema["id"].dataType.simpleString()
    return spread(messages).mapInArrow(make, f"id {kind}, word_hi long, word_lo long, " + ("content string" if content else "field_hi long, field_lo long"))


def _same(x: str, y: str) -> bool:
    if x == y:
        return True
    if "\1" in x and "\1" in y:
        return Counter(x.split("\2")) == Counter(y.split("\2"))
    # a list and its words in the same order
    return words(x) == words(y)


def _source(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return messages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def _followers(src: DataFrame, prints: DataFrame) -> DataFrame:
    """(id, first_id) of the records that are the same as one of a smaller id.

    Groups are found by the prints alone; texts travel once, and only those of groups of two ids or more are looked at.
    """
    # words of a field list lead a text without the layout to the list
    twin = prints.where("field_hi IS NOT NULL").groupBy("word_hi", "word_lo").agg(F.min(F.struct("field_hi", "field_lo", "id")).alias("twin"))
    keyed = prints.join(twin, ["word_hi", "word_lo"], "left").select("id", "word_hi", "word_lo", F.when(F.col("field_hi").isNull(), F.col("twin.id")).alias("via_id"), F.coalesce("twin.field_hi", "word_hi").alias("hi"), F.coalesce("twin.field_lo", "word_lo").alias("lo"))
    many = keyed.groupBy("hi", "lo").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id <> last_id").drop("last_id")
    # repeated rows of an id are one from here on
    member = cut_lineage(keyed.join(many, ["hi", "lo"]).groupBy("id", "word_hi", "word_lo").agg(*(F.min(c).alias(c) for c in ("via_id", "hi", "lo", "first_id"))), "members")
    texts = _prints(src.join(member.select("id").distinct(), "id", "left_semi"), content=True)
    own = cut_lineage(texts.groupBy("id", "word_hi", "word_lo").agg(F.min("content").alias("content")).join(member, ["id", "word_hi", "word_lo"]), "contents")
    via = own.select(F.col("id").alias("via_id"), "hi", "lo", F.col("content").alias("via"))
    own = own.join(via, ["via_id", "hi", "lo"], "left").select("id", "first_id", "hi", "lo", "content", "via")
    first = own.where("id = first_id").select("hi", "lo", F.coalesce("via", "content").alias("first_content"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # words without a layout are compared with the list that has them, and that list with the first
            ok = [_same(x, y) if v is None else _same(x, v) and _same(v, y) for x, v, y in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["id", "first_id"]).filter(pa.array(ok, pa.bool_()))

    kind = prints.schema["id"].dataType.simpleString()
    rows = own.where("id <> first_id").join(first, ["hi", "lo"]).select("id", "first_id", "content", "via", "first_content")
    return rows.mapInArrow(verify, f"id {kind}, first_id {kind}").groupBy("id").agg(F.min("first_id").alias("first_id"))


def copies(messages: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, first_id): every record with the smallest id of the records that are the same; alone it is its own.

    Ids are compared byte by byte.
    """
    src = _source(messages, id_col, text_col)
    prints = cut_lineage(_prints(src), "prints")
    return prints.select("id", F.col("id").alias("first_id")).union(_followers(src, prints)).groupBy("id").agg(F.min("first_id").alias("first_id"))


def pairs(messages: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_1, id_2): the smallest id of each set of equal records with each of the others."""
    src = _source(messages, id_col, text_col)
    return _followers(src, cut_lineage(_prints(src), "prints")).select(F.col("first_id").alias("id_1"), F.col("id").alias("id_2"))


def collapsed(messages: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n_copies): one row for each different record, with the number of ids that it had."""
    return copies(messages, id_col, text_col).groupBy(F.col("first_id").alias("id")).agg(F.count("*").alias("n_copies"))
