"""Benchmark decontamination by winnowing.

The hashes of a text's K-grams are read in windows of SPAN - K + 1; each window selects its least hash, the rightmost one where equal. Equal
spans of SPAN words so have the same selected gram at the same place, whatever stands around them, and a text keeps about two fingerprints
for every SPAN - K + 2 grams. Selected fingerprints of documents and items are joined, and each meeting is extended word by word to the left and to the right,
as far as a span that holds the gram can reach; a run of SPAN words or more is a hit. So every shared span is found, and words
are compared themselves, not their hashes. An item of fewer than SPAN words is one window, and one gram, of its own length.

Rows: one per document row. Null and empty texts have no words and no hits; an empty benchmark gives no hits; very long texts are read
whole; repeated documents are judged one by one; columns besides id, text and ``carry`` are ignored, whatever their names; item ids that
are null are not counted (their words are hit), and equal ids count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import as_bytes, cut, interned, materialize, mix64

SPAN, K = 8, 4
#: How many words beside a gram can belong to a span that holds it.
REACH = SPAN - K
#: Bits of the filter that keeps fingerprints without a counterpart out of the shuffle; it only spares work.
FILTER_BITS = 22

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MK = np.uint64(0xD6E8FEB86659FD93)
_GRAM = [("length", pa.int32()), ("fp", pa.int64()), ("left", pa.list_(pa.string())), ("gram", pa.string()), ("right", pa.list_(pa.string()))]
_CANDIDATE = pa.struct([*_GRAM, ("starts", pa.list_(pa.int32()))])
_SCANNED = pa.struct([("n_words", pa.int64()), ("grams", pa.list_(_CANDIDATE))])
_GRAM_DDL = "length int, fp long, left array<string>, gram string, right array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each place on."""
    acc = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for j in range(k):
        acc = acc * _MK + h[j : j + len(acc)]
    return mix64(acc)


def _winnowed(g: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Places of the grams that the spans at these places select."""
    least, at = g[spans + REACH], spans + REACH
    for j in range(REACH - 1, -1, -1):
        less = g[spans + j] < least
        least, at = np.where(less, g[spans + j], least), np.where(less, spans + j, at)
    return np.unique(at)


class Texts:
    """The words of some texts in a row, and their hashes."""

    def __init__(self, texts: list[bytes]):
        docs = [words(t) for t in texts]
        self.ids, self.starts, names = interned(docs, lambda w: xxhash.xxh64_intdigest(w, 42))
        self.vocabulary = list(names.ids)
        self.h = mix64(names.hashes())[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        self.sizes = np.diff(self.starts)

    def selected(self, length: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places and fingerprints of the grams for windows of ``length`` words; ``whole``: of texts with just so many words."""
        fits = self.sizes == length if whole else self.sizes >= length
        n = np.where(fits, self.sizes - length + 1, 0)
        first = np.repeat(np.cumsum(n) - n, n)
        windows = np.arange(len(first)) - first + np.repeat(self.starts[:-1], n)
        g = _grams(self.h, K if length == SPAN else length)
        at = _winnowed(g, windows) if length == SPAN and len(windows) else windows
        return at, g[at]

    def around(self, length: int, at: int, doc: int) -> tuple[tuple[str, ...], str, tuple[str, ...]]:
        """The words to the left of a gram (the nearest first), its own, and those to the right, as far as a span can reach."""
        k, reach = (K, REACH) if length == SPAN else (length, 0)
        a, b = max(int(self.starts[doc]), at - reach), min(int(self.starts[doc + 1]), at + k + reach)
        own = [self.vocabulary[i].decode() for i in self.ids[a:b].tolist()]
        return tuple(own[: at - a][::-1]), " ".join(own[at - a : at - a + k]), tuple(own[at - a + k :])


def item_grams(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, fp, left, gram, right) of the selected grams of each item, without repeats."""

    def run(batches):
        for batch in batches:
            for part in cut(batch, batch.column(1)):
                texts, names, rows = Texts(as_bytes(part.column(1))), part.column(0).to_pylist(), []
                for length in range(1, SPAN + 1):
                    at, fp = texts.selected(length, length < SPAN)
                    doc = np.searchsorted(texts.starts, at, "right") - 1
                    rows += [(names[d], length, f, *texts.around(length, a, d)) for d, a, f in zip(doc.tolist(), at.tolist(), fp.view(np.int64).tolist(), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), *(t for _, t in _GRAM)], strict=True)], names=["item_id", *(n for n, _ in _GRAM)])

    return benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, f"item_id string, {_GRAM_DDL}").distinct()


def _filter(grams: DataFrame, bits: int) -> tuple[np.ndarray, list[int]]:
    """A bit map of the fingerprints (its size does not depend on the input) and the window lengths there are (SPAN at most)."""
    at = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    rows = grams.groupBy(F.shiftright(at, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))).alias("b"), F.collect_set("length").alias("lengths")).collect()
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    for r in rows:
        bitmap[r["w"]] = r["b"]
    return bitmap, sorted({n for r in rows for n in r["lengths"]})


def candidates(grams: DataFrame, bits: int = FILTER_BITS):
    """A function of the text column: its number of words, and the distinct selected grams whose fingerprint may be the benchmark's, with their places."""
    bitmap, lengths = _filter(grams, bits)
    mask = np.uint64((1 << bits) - 1)

    def run(column: pa.Array) -> pa.Array:
        out = []
        for part in cut(column, column):
            texts = Texts(as_bytes(part))
            found: list[dict] = [{} for _ in range(len(part))]
            for length in lengths:
                at, fp = texts.selected(length, False)
                low = fp & mask
                hit = ((bitmap[low >> np.uint64(5)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)
                at, fp = at[hit], fp[hit]
                doc = np.searchsorted(texts.starts, at, "right") - 1
                for d, a, f in zip(doc.tolist(), at.tolist(), fp.view(np.int64).tolist(), strict=True):
                    found[d].setdefault((length, f, *texts.around(length, a, d)), []).append(a - int(texts.starts[d]))
            names = [f.name for f in _CANDIDATE]
            out += [{"n_words": n, "grams": [dict(zip(names, (*key, at), strict=True)) for key, at in own.items()]} for n, own in zip(texts.sizes.tolist(), found, strict=True)]
        return pa.array(out, _SCANNED)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"struct<n_words:long,grams:array<struct<{_GRAM_DDL.replace(' ', ':').replace(',:', ',')},starts:array<int>>>>")


def _extended(side: str) -> Column:
    """How many words beside the gram are the same in document and item."""
    same, total = F.lit(True), F.lit(0)
    for i in range(REACH):
        same = same & F.coalesce(F.get(side, F.lit(i)) == F.get(f"item_{side}", F.lit(i)), F.lit(False))
        total = total + same.cast("int")
    return total


def _sets(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grams without repeats, each with a number for the set of items that have it; (set, item_id). A set is known by its size and 128 bits of hash, so it never meets in one place."""
    by = [c for c, _ in _GRAM]
    h = [F.bit_xor(F.xxhash64("item_id", F.lit(i))) for i in (1, 2)]
    distinct = materialize(grams.groupBy(*by).agg(F.xxhash64(F.count("item_id"), *h).alias("set"), F.xxhash64(F.lit("again"), F.count("item_id"), *h).alias("set2")), "distinct-grams")
    first = distinct.groupBy("set", "set2").agg(F.min(F.struct(*by)).alias("g")).select("set", "set2", "g.*")
    members = grams.join(first, by).filter("item_id is not null").select("set", "set2", "item_id")
    return distinct, members


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry, n_words, n_hit, items, spans, contaminated) for each row of ``docs``.

    items: the sorted ids with occurring windows; spans: the shared runs found, as (start, length) in words; they may overlap.
    """
    grams = materialize(item_grams(benchmark), "grams")
    distinct, members = _sets(grams)
    scanned = docs.select(F.col(id_col).alias("doc_id"), *carry, candidates(grams)(F.col(text_col)).alias("r")).select(F.monotonically_increasing_id().alias("__row"), "doc_id", *carry, "r.*")
    scanned = materialize(scanned, "scanned")
    found = scanned.filter(F.size("grams") > 0).select("__row", F.explode("grams").alias("g")).select("__row", "g.*")
    met = found.join(distinct.withColumnsRenamed({"left": "item_left", "right": "item_right"}), ["length", "fp", "gram"])
    met = met.withColumns({"before": _extended("left"), "after": _extended("right")})
    size = F.when(F.col("length") < SPAN, F.col("length")).otherwise(F.col("before") + K + F.col("after"))
    hits = met.withColumn("length", F.when((F.col("length") < SPAN) | (size >= SPAN), size)).filter("length is not null").select("__row", "starts", "before", "length", "set", "set2")
    runs = hits.select("__row", F.explode("starts").alias("start"), "before", "length").select("__row", (F.col("start") - F.col("before")).alias("start"), "length").distinct()
    end = F.col("start") + F.col("length")
    covered = F.max(end).over(Window.partitionBy("__row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    spans = runs.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(covered, F.lit(0)))))
    spans = spans.groupBy("__row").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    items = hits.select("__row", "set", "set2").distinct().join(members, ["set", "set2"]).groupBy("__row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    empty = F.array().cast("array<string>")
    return (
        scanned.drop("grams").join(spans, "__row", "left").join(items, "__row", "left")
        .select("doc_id", *carry, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", empty).alias("items"), "spans")
        .withColumn("contaminated", F.size("items") >= min_items)
    )
