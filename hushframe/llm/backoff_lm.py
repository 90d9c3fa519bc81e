"""Language-model scoring with a weighted backoff automaton.

Model: word n-grams smoothed towards the next shorter history, p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu), which sums to one
for every history; mu is a parameter of each length of history. The shortest history discounts every count by ``DISCOUNT`` and gives that mass to the one
event `unknown word`.

Automaton: the empty history and every n-gram seen in training that can be a history are states. A state has an arc with log
p(w | h) for each word seen after it, and a failure arc of log mu / (c(h) + mu) to its longest proper suffix. A text starts
in the state of its beginning and is read once from left to right, adding up the weights of the arcs it takes.

Scale: documents are dealt into chunks of about ``CHUNK_BYTES`` by a hash of id and text. A chunk asks for the counts of its distinct n-grams and brings
its own training counts along, packed and dealt by hash; sums go back in the order asked. So each chunk builds exactly the part of
the automaton that its texts can reach, whatever the size of the model, and a frequent n-gram is one entry a chunk. N-grams are known by
hashes of ``SPARE`` bits more than the number of bytes in the corpus takes, so that about one n-gram in a million is mistaken for another at any size;
sorted hashes take some 32 bits each (high parts in unary, low parts as they are), and of the answers, which tell only what others add, most are zero.

Rows: one per document row; equal rows are learned from as often as they occur and get equal scores. A null or empty text is the end token alone; a null id
counts as the empty text in ``training``; texts of any length are read whole, in a chunk with others. Columns besides id and text are not read, whatever
their names. Without training rows every probability is one and scores are 0 (base_score follows its formula); an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hushframe.llm.common import Interner, as_bytes, forget, materialize, mix64, release

ORDER, MU, DISCOUNT = 3, (1000.0, 5.0), 0.75
CHUNK_BYTES, LEAST_CHUNKS = 4 << 20, 24
#: Texts that are read at once.
BLOCK = 64
SPARE = 18
_M = np.uint64(0x9E3779B97F4A7C15)
_END, _BEGIN = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" begin")
_ASKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("bucket", pa.int64()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("texts", pa.int64())])


def key_bits(size: int) -> int:
    """Bits of an n-gram's hash in a corpus of ``size`` bytes."""
    return min(64, SPARE + max(16, size.bit_length()))


def pack_keys(keys: np.ndarray, bits: int) -> bytes:
    """Sorted distinct keys of so many bits: about two bits of each in unary, the others in whole bytes and then bit by bit."""
    n = len(keys)
    low = max(0, bits - n.bit_length() + 1)
    high = (keys >> np.uint64(low)).astype(np.int64)
    marks = np.zeros(n + int(high[-1]) + 1, np.uint8)
    marks[high + np.arange(n)] = 1
    octets = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : low // 8])
    planes = [np.packbits((keys >> np.uint64(j)).astype(np.uint8) & 1).tobytes() for j in range(low // 8 * 8, low)]
    return b"".join([n.to_bytes(4, "little"), bytes([low]), octets.tobytes(), *planes, np.packbits(marks).tobytes()])


def unpack_keys(data: bytes) -> np.ndarray:
    n, low, at = int.from_bytes(data[:4], "little"), data[4], 5
    octets = np.zeros((n, 8), np.uint8)
    octets[:, : low // 8] = np.frombuffer(data, np.uint8, n * (low // 8), at).reshape(n, -1)
    out = octets.view("<u8").ravel()
    at += n * (low // 8)
    for j in range(low // 8 * 8, low):
        out |= np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(np.uint64) << np.uint64(j)
        at += -(-n // 8)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=at))) - np.arange(n)
    return out | high.astype(np.uint64) << np.uint64(low)


def pack_counts(counts: np.ndarray) -> bytes:
    kind = next(k for k in "BHIQ" if int(counts.max(initial=0)) <= np.iinfo(k).max)
    return kind.encode() + zstandard.compress(counts.astype(kind).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), data[:1].decode()).astype(np.int64)


def _squeezed():
    """Texts go through the shuffle twice; one by one zstd halves them."""

    def run(texts: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(3).compress
        return pa.array([squeeze(t) for t in as_bytes(texts)], pa.binary())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")


def _texts(table: pa.Table) -> list[bytes]:
    restore = zstandard.ZstdDecompressor().decompress
    return [restore(z) for z in table.column("text").to_pylist()]


class Chunk:
    """The tokens of some texts, each text between a begin and an end token, and their distinct n-grams."""

    def __init__(self, texts: list[bytes], order: int, bits: int):
        names = Interner(xxhash.xxh64_intdigest)
        docs = [names(t.lower().split()) for t in texts]
        h = np.concatenate([names.hashes(), np.array([_END, _BEGIN], np.uint64)])
        end, begin = len(h) - 2, len(h) - 1
        #: The place of each text's begin token; its tokens follow.
        self.begin = np.array([0, *accumulate(len(d) + 2 for d in docs)], np.int64)
        self.ids = np.fromiter((x for d in docs for x in (begin, *d, end)), np.int64, int(self.begin[-1]))
        self.end_token, self.begin_token = end, begin
        offset = np.arange(len(self.ids)) - np.repeat(self.begin[:-1], np.diff(self.begin))
        #: By n: the distinct n-grams' keys, sorted; which of them ends at each place, or -1; the places where one ends.
        self.keys: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        self.placed: dict[int, np.ndarray] = {}
        token = h[self.ids]
        acc = np.zeros(len(token), np.uint64)
        for n in range(1, order + 1):
            # acc[i]: of the n tokens up to i
            acc = (np.concatenate([np.zeros(1, np.uint64), acc[:-1]]) + np.uint64(n)) * _M + token if n > 1 else mix64(token)
            acc = mix64(acc) if n > 1 else acc
            places = np.flatnonzero(offset >= n - 1)
            keys, inverse = np.unique(acc[places] >> np.uint64(64 - bits), return_inverse=True)
            at = np.full(len(token), -1, np.int32)
            at[places] = inverse
            self.keys[n], self.at[n], self.placed[n] = keys, at, places

    def counts(self, n: int, learn: np.ndarray) -> np.ndarray:
        """Of each n-gram in the texts to learn from."""
        places = self.placed[n]
        return np.bincount(self.at[n][places[np.repeat(learn, np.diff(self.begin))[places]]], minlength=len(self.keys[n]))


def _asked(order: int, buckets: int, bits: int):
    rest = bits - int(math.log2(buckets))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        chunk = Chunk(_texts(table), order, bits)
        learn = np.asarray(table.column("learn"))
        rows: list[list] = [[] for _ in _ASKED]
        for n in range(1, order + 1):
            keys, counts = chunk.keys[n], chunk.counts(n, learn)
            edges = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << np.uint64(rest)) if buckets > 1 else []
            edges = [0, *edges, len(keys)]
            for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if y > x:
                    own = keys[x:y] - np.uint64(b << rest)
                    for cell, value in zip(rows, (b, table.column("chunk")[0].as_py(), n, pack_keys(own, rest), pack_counts(counts[x:y])), strict=True):
                        cell.append(value)
        release()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ASKED, strict=True)], schema=_ASKED)

    return run


def _told(buckets: int, bits: int):
    rest = bits - int(math.log2(buckets))
    begin = mix64(np.array([_BEGIN], np.uint64))[0] >> np.uint64(64 - bits)

    def run(table: pa.Table) -> pa.Table:
        """Sums the counts of a bucket and answers each chunk with what others add to its own; a row with chunk -1 holds what the whole corpus needs."""
        bucket, rows = table.column("bucket")[0].as_py(), []
        chunks, ns = table.column("chunk").to_pylist(), table.column("n").to_pylist()
        for n in sorted(set(ns)):
            own = [i for i, x in enumerate(ns) if x == n]
            keys = [unpack_keys(table.column("keys")[i].as_py()) for i in own]
            edges = np.cumsum([0, *map(len, keys)])
            counts = np.concatenate([unpack_counts(table.column("counts")[i].as_py()) for i in own])
            seen, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(inverse, counts, len(seen)).astype(np.int64)
            rows += [(chunks[i], n, bucket, pack_counts(sums[inverse[x:y]] - counts[x:y]), None, None, None) for i, x, y in zip(own, edges[:-1], edges[1:], strict=True)]
            if n == 1:
                is_begin = seen == begin - np.uint64(bucket << rest) if begin >> np.uint64(rest) == bucket else np.zeros(len(seen), bool)
                words = sums[~is_begin]
                rows.append((-1, 1, bucket, None, int(words.sum()), int((words > 0).sum()), int(sums[is_begin].sum())))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TOLD, strict=True)], schema=_TOLD)

    return run


class Automaton:
    """The states and arcs that a chunk can reach. Arcs are looked up in bulk: arc[n][i] is the arc labelled with token i from
    the state of the n - 1 tokens before it, or -1."""

    def __init__(self, chunk: Chunk, counts: dict[int, np.ndarray], tokens: int, types: int, mu: tuple[float, ...]):
        order = len(counts)
        self.order = order
        c1 = counts[1]
        unknown = DISCOUNT * types / tokens if tokens else 1.0
        p = np.where(c1 > 0, (c1 - DISCOUNT) / max(tokens, 1), unknown)[chunk.at[1]]
        #: By n: of each place, the log weight of the arc, whether there is one, and the weight of the failure arc of the state that n tokens lead to.
        self.weight, self.arc, self.fail = {1: np.log10(p)}, {1: np.ones(len(p), bool)}, {}
        for n in range(2, order + 1):
            fits = chunk.at[n] >= 0
            before = np.zeros(len(p))
            before[1:] = np.where(chunk.at[n - 1] >= 0, counts[n - 1][chunk.at[n - 1]], 0)[:-1]
            c = np.where(fits, counts[n][chunk.at[n]], 0)
            m = mu[n - 2]
            p = np.where(fits, (c + m * p) / (before + m), p)
            self.weight[n], self.arc[n] = np.log10(p), c > 0
            after = np.where(chunk.at[n - 1] >= 0, counts[n - 1][chunk.at[n - 1]], 0)
            self.fail[n - 1] = np.log10(m / (after + m))
        self.state = {n: np.where(chunk.at[n] >= 0, counts[n][chunk.at[n]], 0) > 0 for n in range(1, order)}

    def read(self, begin: np.ndarray) -> list[float]:
        """Scores of the texts, each read once from left to right."""
        order, out = self.order, []
        for x in range(0, len(begin) - 1, BLOCK):
            # As lists, some texts at a time.
            edges = (begin[x : x + BLOCK + 1] - begin[x]).tolist()
            here = slice(begin[x], begin[min(x + BLOCK, len(begin) - 1)])
            weight, arc = ([None, *(held[n][here].tolist() for n in range(1, order + 1))] for held in (self.weight, self.arc))
            fail, state = ([None, *(held[n][here].tolist() for n in range(1, order))] for held in (self.fail, self.state))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                total = 0.0
                depth = 1 if order > 1 and state[1][a] else 0  # how many tokens the state remembers
                for i in range(a + 1, b):
                    while depth and not arc[depth + 1][i]:
                        total += fail[depth][i - 1]
                        depth -= 1
                    total += weight[depth + 1][i]
                    # The arc leads to the longest state that the tokens so far end with.
                    depth = min(depth + 1, order - 1)
                    while depth and not state[depth][i]:
                        depth -= 1
                out.append(total)
        return out


def _scored(order: int, mu: tuple[float, ...], bits: int, tokens: int, types: int, out: pa.Schema):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        if not table.num_rows:
            return out.empty_table()
        chunk = Chunk(_texts(table), order, bits)
        by = {}
        for n, bucket, data in zip(told.column("n").to_pylist(), told.column("bucket").to_pylist(), told.column("counts").to_pylist(), strict=True):
            by[n, bucket] = unpack_counts(data)
        # A zero at the end, for the place -1 of what is no n-gram.
        learn = np.asarray(table.column("learn"))
        none = np.zeros(1, np.int64)
        others = {n: np.concatenate([none[:0], *(by[k] for k in sorted(by) if k[0] == n)]) for n in range(1, order + 1)}
        counts = {n: np.concatenate([others[n] + chunk.counts(n, learn), none]) for n in others}
        score = Automaton(chunk, counts, tokens, types, mu).read(chunk.begin)
        c = counts[1][chunk.at[1]]
        base = np.log10((c + 1) / (tokens + types + 1))
        base[chunk.begin[:-1]] = 0
        known = c > 0
        known[chunk.begin[:-1]] = False
        n_tokens = np.diff(chunk.begin) - 1
        cols = [table.column("doc_id").combine_chunks(), table.column("learn").combine_chunks(), pa.array(n_tokens), pa.array(np.add.reduceat(known.astype(np.int64), chunk.begin[:-1])), pa.array(np.full(len(score), tokens)), pa.array(np.add.reduceat(base, chunk.begin[:-1])), pa.array(score, pa.float64())]
        release()
        return pa.Table.from_arrays(cols, schema=out)

    return run


def score(docs: DataFrame, training: Column, order: int = ORDER, mu: tuple[float, ...] = MU, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of each row; learned: whether the model has seen it. ``mu``: for histories of 1, 2, ... words."""
    forget(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks = max(LEAST_CHUNKS, -(-size // chunk_bytes))
    buckets, bits = 1 << (chunks - 1).bit_length(), key_bits(size)
    dealt = docs.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(chunks)).alias("chunk"), F.col(id_col).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("learn"), _squeezed()(text).alias("text"))
    asked = dealt.groupBy("chunk").applyInArrow(_asked(order, buckets, bits), "bucket long, chunk long, n int, keys binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(_told(buckets, bits), "chunk long, n int, bucket long, counts binary, tokens long, types long, texts long")
    told = materialize(told, "told")
    sums = told.filter("chunk = -1").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = sums[0] or 0, sums[1] or 0
    forget(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    fields = [("doc_id", id_type.simpleString()), ("learned", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")]
    out = pa.schema([("doc_id", to_arrow_type(id_type)), ("learned", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
    answers = told.filter("chunk >= 0").select("chunk", "n", "bucket", "counts")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(order, mu, bits, tokens, types, out), ", ".join(f"{n} {t}" for n, t in fields))
