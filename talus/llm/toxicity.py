"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: word beginnings that occur in toxic documents far more
often than in others, from one part of the labelled sample.  Trees are grown on
the second part and calibrated on the third, so neither sees the lexicon's own
documents.  Fitting takes a bounded sample of labelled rows (``SAMPLE``, those of
the least hash); scoring covers every text whole, in one pass without a shuffle,
with a model of a few kilobytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import small

#: Most labelled rows that fitting reads.
SAMPLE = 12_000
MIN_SUPPORT, MIN_LOG_ODDS, STEMS = 4, 2.5, (4, 5, 6)
FOLDS = 5
#: Words whose weights a task remembers at once.
MEMO = 100_000

# Insults that the lexicon starts from, and second-person words.
INSULTS = "disgusting dumb fool idiot imbecile jerk loser moron pathetic scum stupid trash ugly vermin worthless".split()
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())

WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"\b(?=\w*[^\W\d_])(?=[\w@$!]*[\d@$])[\w@$!]+")
SHOUTED = re.compile(r"\b[A-ZÄÖÜÉÈÊÇÁÍÓÚÑ]{3,}\b")
PLAIN = str.maketrans("013457@$!", "oieastasi")
FEATURES = "hits density weight distinct insults near_you obfuscated mixed capitals shouted exclaimed questioned repeated words".split()


def features(text: str | None, lexicon: dict[str, float], memo: dict[str, float]) -> list[float]:
    """The dense features of a whole text; null is read as empty.  ``memo`` keeps words' lexicon weights."""
    text = text or ""
    words = WORD.findall(text.lower())
    n = max(1, len(words))

    def weigh(word: str) -> float:
        found = lexicon.get(word, 0.0)
        for k in STEMS:
            found = max(found, lexicon.get(word[:k] + "*", 0.0) if len(word) >= k else 0.0)
        if len(memo) > MEMO:
            memo.clear()
        memo[word] = found
        return found

    listed = {w: x for w in set(words) if (x := memo[w] if w in memo else weigh(w))}
    at = [i for i, w in enumerate(words) if w in listed] if listed else []
    near = sum(1 for i in at if not SECOND_PERSON.isdisjoint(words[max(0, i - 4) : i + 5]))
    insults = sum(1 for i in at if words[i] in INSULTS)
    mixed = MIXED.findall(text) if any(c in text for c in "013457@$!") else []
    hidden = sum(1 for w in mixed if (p := w.lower().translate(PLAIN)) in INSULTS or lexicon.get(p, 0.0) > 0)
    size = max(1, len(text))
    return [
        float(len(at)),
        len(at) / n,
        sum(listed[words[i]] for i in at) / n,
        float(len(listed)),
        insults / n,
        near / n,
        float(hidden),
        len(mixed) / n,
        sum(map(str.isupper, text)) / size if not text.islower() else 0.0,
        len(SHOUTED.findall(text)) / n,
        text.count("!") / size,
        text.count("?") / size,
        (text.count("!!") + text.count("??")) / size,
        math.log1p(len(words)),
    ]


@dataclass
class Trees:
    """Boosted trees of logistic loss over histogram bins; each tree is arrays of feature, cut and value, by heap place."""

    base: float
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node]
        return out


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting with second-order gains; leaves without gain stay as they are."""
    p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Trees(math.log(p / (1 - p)), depth, [])
    if not len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    margin = np.full(len(y), model.base)
    size = (1 << depth + 1) - 1
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        feature, cut, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for place in range((1 << depth) - 1):
            rows = np.flatnonzero(node == place)
            best = (1e-6, None, None)
            if len(rows) >= 2:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    left_g = np.cumsum(np.bincount(binned[j][rows], g[rows], len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[j][rows], h[rows], len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] is not None:
                feature[place], cut[place] = best[1], cuts[best[1]][best[2]]
                node[rows] = 2 * place + 1 + (binned[best[1]][rows] > best[2])
            else:
                node[rows] = 2 * place + 1
        leaf_g, leaf_h = np.bincount(node, g, size), np.bincount(node, h, size)
        value = -rate * leaf_g / (leaf_h + ridge)
        model.trees.append((feature, cut, value))
        margin += value[node]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and the increasing probabilities there, to interpolate between."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, first and last margin
    for m, label in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([label, 1.0, m, m])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    places = [x for b in blocks for x in (b[2], b[3])]
    return np.array(places), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    places: np.ndarray
    chances: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x)
        raw = 1 / (1 + np.exp(-margin))
        # Mostly the calibrated chance; a little of the raw one orders texts within a block.
        return raw if not len(self.places) else 0.98 * np.interp(margin, self.places, self.chances) + 0.02 * raw


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def _learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and word beginnings of ``rows`` (text, toxic) with their log odds."""
    words = "array_distinct(array_remove(split(lower(text), '[^\\\\p{L}]+'), ''))"
    stems = ", ".join(f"transform(filter(w, x -> length(x) >= {k}), x -> concat(substring(x, 1, {k}), '*'))" for k in STEMS)
    entries = rows.dropDuplicates(["text"]).select("toxic", F.explode(F.expr(f"transform(array({words}), w -> array_distinct(concat(w, {stems})))[0]")).alias("entry"))
    n_toxic, n_all = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not n_toxic or n_toxic == n_all:
        return {}
    counted = entries.groupBy("entry").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where(F.col("t") >= MIN_SUPPORT)
    odds = F.log((F.col("t") + 0.5) / float(n_toxic) / ((F.col("n") - F.col("t") + 0.5) / float(n_all - n_toxic)))
    best = counted.select("entry", odds.alias("odds")).where(F.col("odds") >= MIN_LOG_ODDS)
    return {r["entry"]: float(r["odds"]) for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rows of ``labels`` (doc_id, toxic) that are not held out.

    Labels that are neither 0 nor 1 and rows without a document are passed over;
    of a doc_id's several labels the largest counts, and of its several texts one.
    The lexicon takes every entry that the sample supports.  Without usable labels the
    model falls back on the fixed insults.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text a label, that of least hash, so that a doc_id that repeats doesn't outgrow the sample.
    known = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(20))
    known = known.withColumn("part", F.when(part < 9, 0).when(part < 16, 1).otherwise(2))
    lexicon = _learn_lexicon(known.where("part = 0").select("text", "toxic"))
    lexicon = {**{w: 3.0 for w in INSULTS}, **lexicon}
    rows = known.where("part > 0")
    made = rows.select("part", "toxic", "text").mapInArrow(_with_features(lexicon), "part int, toxic int, x array<double>").toPandas()
    x = np.array(made["x"].tolist(), float).reshape(-1, len(FEATURES))
    y, first = made["toxic"].to_numpy(float), made["part"].to_numpy() == 1
    order = np.lexsort(x.T)  # rows come in any order; sums must not depend on it
    x, y, first = x[order], y[order], first[order]
    if len(y) and 0 < y[first].sum() < first.sum():
        trees = grow(x[first], y[first])
    else:
        taught = np.zeros((2, len(FEATURES)))
        taught[1, [0, 1, 2, 3, 4]] = [1, 0.01, 0.03, 1, 0.01]
        trees = grow(np.repeat(taught, 50, axis=0), np.repeat([0.0, 1.0], 50))
    rest = ~first
    places, chances = isotonic(trees.margin(x[rest]), y[rest]) if rest.sum() >= 30 and 0 < y[rest].sum() < rest.sum() else (np.empty(0), np.empty(0))
    return Model(lexicon, trees, places, chances)


def _with_features(lexicon: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in small(batches):
            made = [features(t.as_py(), lexicon, memo) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.float64()))], ["part", "toxic", "x"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, suffix: str = "") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), with the columns of ``keep`` before them.

    ``suffix`` is added to the three new names, where kept columns have such names.

    Null and empty texts are scored as texts without words.  Repeated rows stay
    repeated; a null doc_id is kept, and held out as the empty text's crc32 says.
    """
    names = list(dict.fromkeys(["doc_id", *(keep or [])]))
    rows = docs.select(*(c for c in names if c != "text"), held_out().alias(f"held_out{suffix}"), F.col("text").cast("string").alias("text"))
    out = rows.schema.fields if "text" in names else rows.schema.fields[:-1]
    schema = StructType([*out, StructField(f"score{suffix}", DoubleType()), StructField(f"predicted{suffix}", IntegerType())])
    width = len(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in small(batches):
            x = np.array([features(t.as_py(), model.lexicon, memo) for t in batch.column(batch.num_columns - 1)], float).reshape(-1, len(FEATURES))
            found = np.clip(model.score(x), 0.0, 1.0)
            columns = [*batch.columns[:width], pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:width], f"score{suffix}", f"predicted{suffix}"])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: list[str] | None = None, suffix: str = "") -> DataFrame:
    """``score`` of ``docs`` by a model ``fit`` to its own labelled rows."""
    return score(docs, fit(docs, labels, sample), keep, suffix)
