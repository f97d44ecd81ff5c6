"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed, every ``GRAM`` consecutive words give one hash, and of every
``span - GRAM + 1`` consecutive hashes the least is kept (leftmost on ties).  A
passage of ``span`` words that document and item share contains one such run of
hashes, so both sides keep the same one: joining kept hashes and extending each
match word by word finds every shared passage of ``span`` words or more.  Items
shorter than ``span`` words are one window each; for the few lengths that occur,
every run of that many words is a fingerprint.

Scale: the corpus is read once.  A generated stage walks the positions of each
document and tests its hash against a bit map of the item fingerprints (a
constant of at most 2^21 bits), then whether it is a window's least; nearly all
positions end there and no row is made of them.  What passes is joined on the
hash (Catalyst broadcasts the item side only below its size threshold) and
carries its own neighbouring words, so texts are never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered

SEPARATORS = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GRAM = 4
MAX_MAP_BITS = 21


@dataclass(frozen=True)
class Level:
    """Windows of ``span`` words: ``gram`` words to a hash, the least of ``window`` hashes kept."""

    span: int
    gram: int

    @property
    def window(self) -> int:
        return self.span - self.gram + 1

    @property
    def column(self) -> str:
        return f"g{self.span}"


def words_of(text: str = "text") -> Column:
    """Lower-cased words of a text; null has none."""
    return F.expr(f"array_remove(split({lowered(f'coalesce({text}, "")')}, '{SEPARATORS}'), '')")


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _grams(k: int) -> str:
    """SQL: the hash of every ``k`` consecutive words, from the word hashes ``h``.

    Runs are joined in pairs: the hash of n words from two hashes of fewer.
    """
    if k == 1:
        return "h"
    a = 1 << (k - 1).bit_length() - 1  # the left part; the right one has k - a words
    both = "zip_with(slice({l}, 1, size(h) - {n}), slice({r}, {s}, size(h) - {n}), (x, y) -> xxhash64(x, y))"
    joined = both.format(l=f"p{a}", r=f"q{k - a}", n=k - 1, s=a + 1)
    return _let(f"p{a}", _grams(a), _let(f"q{k - a}", f"p{a}" if k - a == a else _grams(k - a), joined))


def _least_of_window(level: Level) -> Column:
    """Whether the hash at ``at`` is the (leftmost) least of a window that holds it."""
    g, here, most = level.column, f"get({level.column}, at)", level.window - 1

    def run(offset: str, larger: str) -> str:
        cases = " ".join(f"WHEN NOT coalesce(get({g}, at {offset} {j}) {larger} {here}, false) THEN {j - 1}" for j in range(1, most + 1))
        return f"CASE {cases} ELSE {most} END"

    return F.expr(f"({run('-', '>')}) + ({run('+', '>=')}) >= {most}") if most else F.lit(True)


def _fingerprints(rows: DataFrame, keys: list[str], levels: list[Level], bitmap: tuple[int, str] | None) -> DataFrame:
    """Kept hashes of ``rows`` (keys, words): level, at, hash, gram, left, right.

    With a bit map, only hashes that it has, and besides one row of level 0 for
    each input row, with a hash that spreads these rows evenly.
    """
    grams = [F.expr(f"if(size(words) < {v.span}, cast(array() as array<bigint>), {_let('h', 'transform(words, x -> xxhash64(x))', _grams(v.gram))})").alias(v.column) for v in levels]
    places = rows.select(*keys, "words", *grams).select("*", F.explode(F.expr("sequence(0, size(words))")).alias("at"))

    def passes(v: Level) -> Column:
        inside = F.col("at") < F.size(v.column)
        if bitmap:
            bits, marks = bitmap
            code = f"get({v.column}, at)"
            inside = inside & F.expr(f"(shiftrightunsigned(get({marks}, cast(shiftrightunsigned({code}, {64 - bits + 6}) as int)), cast(shiftrightunsigned({code}, {64 - bits}) & 63 as int)) & 1L) = 1L")
        else:  # an item has windows of one length
            inside = inside & ((F.size("words") >= v.span) if v == levels[0] else (F.size("words") == v.span))
        return inside & _least_of_window(v)

    tests = {v.span: passes(v) for v in levels}
    if bitmap:
        tests[0] = F.col("at") == F.size("words")
    some = places.where(reduce(or_, tests.values()))
    # Still in the generated stage: what goes on is a few words around the place, never the whole text.
    reach = levels[0].span
    near = some.select(
        *keys,
        F.size("words").alias("n_words"),
        "at",
        F.expr(f"slice(words, greatest(at - {reach}, 0) + 1, {2 * reach})").alias("near"),
        *(t.alias(f"is{n}") for n, t in tests.items()),
        *(F.expr(f"get({v.column}, at)").alias(v.column) for v in levels),
    )
    each = near.withColumn("level", F.explode(F.array_compact(F.array(*(F.when(F.col(f"is{n}"), F.lit(n)) for n in tests)))))
    code, gram, around = F.xxhash64(*keys), F.lit(0), F.lit(0)
    for v in levels:
        here = F.col("level") == v.span
        code, gram, around = F.when(here, F.col(v.column)).otherwise(code), F.when(here, v.gram).otherwise(gram), F.when(here, v.window - 1).otherwise(around)
    cut = each.withColumn("k", gram).withColumn("around", around).withColumn("i", F.least(F.col("at"), F.lit(reach)))
    return cut.select(
        *keys,
        "n_words",
        "level",
        "at",
        code.alias("hash"),
        F.expr("slice(near, i + 1, k)").alias("gram"),
        F.expr("reverse(slice(near, greatest(i - around, 0) + 1, least(i, around)))").alias("left"),
        F.expr("slice(near, i + k + 1, around)").alias("right"),
    )


def _run(a: str, b: str) -> str:
    """SQL: how many leading elements two arrays share."""
    same = f"zip_with({a}, {b}, (x, y) -> coalesce(x = y, false))"
    return _let("s", same, "if(array_position(s, false) = 0, size(s), cast(array_position(s, false) as int) - 1)")


def _bit_map(item_side: DataFrame) -> tuple[int, str]:
    """How many bits, and SQL for an array constant of longs with a bit for each item hash.

    Its size depends on the number of item fingerprints up to ``MAX_MAP_BITS``;
    beyond that it only lets more candidates through to the join.
    """
    bits = min(MAX_MAP_BITS, max(12, math.ceil(math.log2(32 * item_side.count() + 1))))
    index = f"shiftrightunsigned(i_hash, {64 - bits})"
    words = item_side.groupBy(F.expr(f"shiftright({index}, 6)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({index} & 63 as int)))").alias("m"))
    marks = {r["w"]: r["m"] for r in words.collect()}
    text = ",".join(str(marks.get(i, 0)) for i in range(1 << (bits - 6)))
    return bits, f"cast(split('{text}', ',') as array<bigint>)"


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 10, gram: int = GRAM) -> DataFrame:
    """Which words of each document lie in a passage of an item.

    docs: doc_id, text.  items: item_id, text.  Other columns play no part.
    Result, a row per input row: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, text_hash (xxhash64 of the text, to join by).

    Null and empty texts have no words; items without words match nothing.  Rows
    that repeat are looked up as one and stay repeated; a null doc_id is kept.  Items that share an id count once; a null item_id marks words but
    is neither counted nor listed.  Empty tables give empty or clean results.
    """
    parsed = items.select(F.col("item_id").cast("string").alias("item_id"), words_of().alias("words")).where("size(words) > 0")
    # A bounded answer: at most `span` lengths.
    lengths = [r["n"] for r in parsed.groupBy(F.least(F.size("words"), F.lit(span)).alias("n")).count().collect()]
    levels = [Level(span, gram), *(Level(m, m) for m in sorted(lengths) if m < span)]
    item_side = (
        _fingerprints(parsed, ["item_id"], levels, None)
        .select("item_id", *(F.col(c).alias(f"i_{c}") for c in ("level", "hash", "gram", "left", "right")))
        .groupBy("i_level", "i_hash", "i_gram", "i_left", "i_right")
        .agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of().alias("words"))
    spread = _fingerprints(rows, ["doc_id", "text_hash"], levels, _bit_map(item_side))
    same = (F.col("level") == F.col("i_level")) & (F.col("hash") == F.col("i_hash")) & (F.col("gram") == F.col("i_gram"))
    joined = spread.join(item_side, same, "left")
    sized = joined.withColumn("before", F.expr(_run("left", "i_left"))).withColumn("after", F.expr(_run("right", "i_right")))
    hit = F.col("ids").isNotNull() & (F.col("before") + F.size("gram") + F.col("after") >= F.col("level"))
    per_doc = (
        sized.select(
            "doc_id",
            "text_hash",
            "n_words",
            "level",
            F.when(hit, F.struct((F.col("at") - F.col("before")).alias("s"), (F.col("at") + F.size("gram") + F.col("after")).alias("e"))).alias("span"),
            F.when(hit, F.col("ids")).alias("ids"),
        )
        .groupBy("doc_id", "text_hash")
        .agg(F.max("n_words").cast("long").alias("n_words"), F.count_if(F.col("level") == 0).alias("times"), F.array_sort(F.collect_set("span")).alias("spans"), F.flatten(F.collect_set("ids")).alias("ids"))
    )
    union = (
        "aggregate(spans, named_struct('end', 0, 'n', 0L), (a, x) -> named_struct('end', greatest(a.end, x.e), "
        "'n', a.n + cast(greatest(x.e - greatest(a.end, x.s), 0) as bigint)), a -> a.n)"
    )
    ids = F.array_sort(F.array_distinct("ids"))
    out = per_doc.select("doc_id", "n_words", F.expr(union).alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "text_hash", "times")
    out = out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "text_hash")
