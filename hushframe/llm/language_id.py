"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram of letters is the product of its letters'
vectors, each permuted (rotated) by its place. A text is the sum of its n-gram vectors, a language the sum of its training
texts scaled to length one; a text gets the language whose vector has the largest cosine with its own.

Rows: one per document row; repeated rows are predicted and learned from one by one; an empty table gives no rows; columns besides id, text and
language are not read, whatever their names. `und` with score 0: a null text, one without letters, or nothing learned. Ties go to the language
that sorts first. Very long texts are read whole, in pieces. Training rows need a text and a language.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import cut, mix64

DIM, N, SEED = 1024, 3, 7
UNKNOWN = "und"
#: Products of n-gram counts and vectors are taken for so many counts at once.
_CELLS = 1 << 21


class _Letters:
    """Numbers code points: letters lower-cased from 1 on, all else 0 (a gap)."""

    def __init__(self):
        self.code = np.full(0x110000, -1, np.int32)
        self.points: list[int] = [32]

    def __call__(self, points: np.ndarray) -> np.ndarray:
        new = points[self.code[points] < 0]
        for p in np.unique(new).tolist():
            c = chr(p)
            low = c.lower()
            if not unicodedata.category(c).startswith("L"):
                self.code[p] = 0
            elif len(low) == 1 and low != c:
                self.code[p] = self(np.array([ord(low)]))[0]
            else:
                self.code[p] = len(self.points)
                self.points.append(p)
        return self.code[points]


def _letter_vectors(points: list[int]) -> np.ndarray:
    cells = mix64(np.array(points, np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(DIM // 64, dtype=np.uint64) + np.uint64(SEED << 50))
    bits = np.unpackbits(cells.view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


class Encoder:
    """Counts n-grams of letters and bundles their vectors."""

    def __init__(self):
        self.letters = _Letters()

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, packed n-gram) of each n-gram with a letter in its middle; a gap before and after each text, runs of gaps as one."""
        points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = self.letters(points)
        owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
        code, owner = code[keep].astype(np.int64), owner[keep]
        if len(code) < N:
            return owner[:0], code[:0]
        key = code[: len(code) - N + 1].copy()
        for j in range(1, N):
            key = (key << 21) | code[j : len(code) - N + 1 + j]
        fits = (owner[N - 1 :] == owner[: len(key)]) & (code[N // 2 : N // 2 + len(key)] != 0)
        return owner[: len(key)][fits], key[fits]

    def compact(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams and the place of each occurrence among them; by counting where the alphabet is small."""
        k = len(self.letters.points)
        if k**N <= 1 << 22 and len(key):
            flat = np.zeros(len(key), np.int64)
            for j in range(N):
                flat = flat * k + ((key >> (21 * (N - 1 - j))) & 0x1FFFFF)
            seen = np.flatnonzero(np.bincount(flat, minlength=k**N))
            place = np.zeros(k**N, np.int32)
            place[seen] = np.arange(len(seen))
            out, rest = np.zeros(len(seen), np.int64), seen
            for j in range(N):
                out |= (rest % k) << (21 * j)
                rest = rest // k
            return out, place[flat]
        return np.unique(key, return_inverse=True)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        letters = _letter_vectors(self.letters.points)
        out = np.ones((len(keys), DIM), np.float32)
        for j in range(N):
            out *= np.roll(letters, N - 1 - j, axis=1)[(keys >> (21 * (N - 1 - j))) & 0x1FFFFF]
        return out

    def bundle(self, texts: list[str]) -> np.ndarray:
        """The summed vectors of each text."""
        owner, key = self.grams(texts)
        out = np.zeros((len(texts), DIM), np.float32)
        if not len(key):
            return out
        seen, place = self.compact(key)
        for a in range(0, len(seen), 4096):
            vectors = self.vectors(seen[a : a + 4096])
            width, rows = len(vectors), max(1, _CELLS // len(vectors))
            mine = (place >= a) & (place < a + width)
            who, what = owner[mine], place[mine] - a
            for b in range(0, len(texts), rows):
                x, y = np.searchsorted(who, [b, b + rows])
                counts = np.bincount((who[x:y] - b) * width + what[x:y], minlength=min(rows, len(texts) - b) * width)
                out[b : b + rows] += counts.reshape(-1, width).astype(np.float32) @ vectors
        return out


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their vectors of length one: DIM numbers per language reach the driver."""

    def run(batches):
        encoder, sums = Encoder(), {}
        for batch in batches:
            for part in cut(batch, batch.column(0)):
                vectors = encoder.bundle([t or "" for t in part.column(0).to_pylist()]).astype(np.float64)
                length = np.sqrt((vectors**2).sum(1, keepdims=True))
                vectors /= np.where(length > 0, length, 1)
                langs = np.array(part.column(1).to_pylist(), object)
                for lang in sorted(set(langs)):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(0)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": [k for k in sums for _ in range(DIM)], "at": [i for _ in sums for i in range(DIM)], "x": [float(round(x, 6)) for v in sums.values() for x in v]}, schema=pa.schema([("lang", pa.string()), ("at", pa.int32()), ("x", pa.float64())]))

    parts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna().mapInArrow(run, "lang string, at int, x double")
    rows = parts.groupBy("lang", "at").agg(F.sum(F.col("x").cast("decimal(28,6)")).cast("double").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).orderBy("lang").collect()
    vectors = np.array([[p["x"] for p in r["v"]] for r in rows], np.float64).reshape(len(rows), DIM)
    return [r["lang"] for r in rows], (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(langs: list[str], vectors: np.ndarray) -> object:
    """A function of the text column: struct of lang_pred and score, the cosine (0 where negative)."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    held = []

    def run(texts: pa.Array) -> pa.Array:
        encoder = held[0] if held else held.append(Encoder()) or held[0]
        names, scores = [], []
        for part in cut(texts, texts):
            own = encoder.bundle([t or "" for t in part.to_pylist()])
            length = np.linalg.norm(own, axis=1)
            cosines = own @ vectors.T / np.maximum(length, 1e-12)[:, None] if langs else np.zeros((len(own), 1))
            best = cosines.argmax(1)
            known = (length > 0) & bool(langs)
            names += [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores += [float(min(1, max(0, c[b]))) if k else 0.0 for c, b, k in zip(cosines, best, known, strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<lang_pred:string,score:double>")


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, learned from the rows where ``training`` holds."""
    langs, vectors = prototypes(docs.filter(training), text_col, lang_col)
    return docs.select(F.col(id_col).alias("doc_id"), predict(langs, vectors)(F.col(text_col)).alias("r")).select("doc_id", "r.*")
