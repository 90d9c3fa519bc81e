"""Removal of long repeated byte strings, found by suffix sorting.

A string of ``length`` bytes is judged repeated where it also starts earlier (in a document with a smaller id, or earlier in the same one); every
byte it covers goes. Strings are judged on the input.

Windows of ``length`` bytes that are equal have the same least hash of their ``GRAM``-byte grams. Consecutive windows with the same
least hash are one context; contexts are dealt by that hash. Equal contexts (told by BLAKE2b, 128 bits) are copies, and their place alone decides. Of the
others, one copy each is fetched and cut to the stretches in which every gram recurs; the stretches of a hash are joined and suffix-sorted
(``gsaca``), and windows that stand together in suffix order and are equal byte by byte are repeats of the earliest. Stretches of one hash that are too
many for a piece are dealt again by the least of other hashes, as equal windows agree in any of them. So only text around the
ends of repeats is ever sorted, always in the same way and in bounded pieces.

Rows: one per document row. Null is an empty text, which has no string and loses nothing. A null doc_id comes after all others; rows that repeat a
doc_id stand in order of a hash of their text, and rows that repeat doc_id and text are one document with one result. Texts of any length are read
whole; an empty table gives no rows; columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hushframe.llm.common import as_bytes, cut, forget, materialize, mix64
from hushframe.llm.gsaca import suffix_array

LENGTH, GRAM = 100, 32
CHUNK_BYTES, LEAST_CHUNKS = 4 << 20, 24
#: Stretches are sorted together up to so many bytes; those of one hash that are more than LARGE are dealt again, so often at most.
SORTED, LARGE, DEALT = 1 << 15, 1 << 18, 8
#: A bucket takes the anchors of so many chunks. Anchors are packed when there are PACKED for each bucket, but from LEAST to HELD in all.
BUCKET_CHUNKS, PACKED, LEAST, HELD = 4, 64, 1 << 17, 1 << 19
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)
#: So many chunks' anchors meet in one task at most; with more, those of a hash are first sifted part by part.
MEETING = 256
_FOUND = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])
#: Least hash, digest of the context, document, start, bytes, and whether it may hold a window twice.
_ANCHOR = np.dtype([("m", "<u8"), ("c", "<u8"), ("d", "<u8"), ("key", "<i8"), ("lo", "<i8"), ("size", "<u4"), ("inner", "?")])


def chunk_of(keys: np.ndarray, chunks: int) -> np.ndarray:
    """pmod(hash(key), chunks) as Spark has it (32-bit Murmur3 of a long), so that ids in steps are dealt evenly."""
    rotated = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h = np.full(len(keys), 42, np.uint32)
    for half in np.ascontiguousarray(keys.astype("<i8")).view("<u4").reshape(-1, 2).T:
        k = rotated(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rotated(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % chunks


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def grams(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at each place; ``gram`` is a power of two."""
    h, n = _TABLE[raw], 1
    while n < gram:
        step = np.uint64((int(_B) * n) % (1 << 64))
        h = (h[:-n] * _A) ^ (h[n:] + step)
        h ^= h >> np.uint64(29)
        n *= 2
    return mix64(h)


def contexts(data: bytes, length: int = LENGTH, gram: int = GRAM, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(least hash, start, size) of each context, and whether one may hold a window twice. ``salt`` orders grams anew."""
    if len(data) < length:
        return *(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64)), False
    width = length - gram + 1
    g = grams(np.frombuffer(data, np.uint8), gram)
    g = mix64(g + np.uint64(salt)) if salt else g
    m = _sliding(g, width, np.minimum)
    lo = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    end = np.concatenate([lo[1:], [len(m)]]) - 1 + length
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.count_nonzero(g == _sliding(np.concatenate([pad, m, pad]), width, np.maximum))
    return m[lo], lo, end - lo, chosen > len(lo)


def anchors(key: int, data: bytes, length: int, gram: int) -> np.ndarray:
    m, lo, size, inner = contexts(data, length, gram)
    out = np.zeros(len(m), _ANCHOR)
    digests = b"".join([blake2b(data[a : a + n], digest_size=16).digest() for a, n in zip(lo.tolist(), size.tolist(), strict=True)])
    out["c"], out["d"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    out["m"], out["key"], out["lo"], out["size"], out["inner"] = m, key, lo, size, inner
    return out


def _pack(x: np.ndarray) -> bytes:
    """Columns one after the other, each in the least width; the first ones sorted as differences."""
    out = [len(x).to_bytes(4, "little")]
    for name in x.dtype.names:
        col = x[name]
        if name == "inner":
            out.append(b"\x01" + col.tobytes())
            continue
        if name == "m":
            col = np.diff(col, prepend=np.uint64(0))
        width = 8 if int(col.min()) < 0 else max(1, (int(col.max()).bit_length() + 7) // 8)
        out.append(bytes([width]) + np.ascontiguousarray(col.astype("<i8" if col.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes())
    return b"".join(out)


def _unpack(data: bytes) -> np.ndarray:
    n, at = int.from_bytes(data[:4], "little"), 4
    out = np.zeros(n, _ANCHOR)
    for name in _ANCHOR.names:
        width = data[at]
        part = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(n, width)
        at += 1 + n * width
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = part
        col = full.view("<u8").ravel()
        out[name] = np.cumsum(col, dtype=np.uint64) if name == "m" else col.view("<i8") if name in ("key", "lo") else col
    return out


def _scan(length: int, gram: int, buckets: int, parts: int):
    """Anchors of the documents, packed by hash; a part is a share of the documents."""

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(found)
        part = int(chunk_of(rows["key"][:1], parts)[0])
        bucket = (rows["m"] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((rows["m"], bucket))
        rows, bucket = rows[order], bucket[order]
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(rows)]
        return pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a in edges[:-1]], pa.int64()), pa.array([part] * (len(edges) - 1), pa.int64()), pa.array([_pack(rows[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], schema=_FOUND)

    def run(batches):
        found, held, enough = [], 0, min(HELD, max(LEAST, PACKED * buckets))
        for batch in batches:
            for slice_ in cut(batch, batch.column(1)):
                for key, data in zip(slice_.column(0).to_pylist(), as_bytes(slice_.column(1)), strict=True):
                    own = anchors(key, data, length, gram)
                    if len(own):
                        found.append(own)
                        held += len(own)
                    if held >= enough:
                        yield packed(found)
                        found, held = [], 0
        if found:
            yield packed(found)

    return run


_SIFTED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("wanted", pa.bool_()), ("data", pa.binary())])


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors by hash, context and place; where a hash and where a context begins; and which anchors are the first of their context."""
    rows = np.concatenate([_unpack(x) for x in table.column("data").to_pylist()])
    rows = rows[np.lexsort((rows["lo"], rows["key"], rows["d"], rows["c"], rows["m"]))]
    new_group = np.concatenate([[True], rows["m"][1:] != rows["m"][:-1]])
    new = new_group | np.concatenate([[True], (rows["c"][1:] != rows["c"][:-1]) | (rows["d"][1:] != rows["d"][:-1])])
    first = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return rows, new_group, new, (rows["key"] == first["key"]) & (rows["lo"] == first["lo"])


def _by_chunk(rows: np.ndarray, chunks: int) -> list[tuple[int, bytes]]:
    chunk = chunk_of(rows["key"], chunks)
    order = np.lexsort((rows["m"], chunk))
    rows, chunk = rows[order], chunk[order]
    edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(rows)] if len(rows) else [0]
    return [(int(chunk[a]), _pack(rows[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _sift(chunks: int):
    """Of the anchors of a bucket and part: the first of each context stays, the others are copies."""

    def run(table: pa.Table) -> pa.Table:
        rows, _, _, original = _ordered(table)
        bucket = table.column("bucket")[0].as_py()
        # Rows with the same place are one document's; one of them stands for all.
        stays = rows[original]
        stays = stays[np.concatenate([[True], (stays[["m", "c", "d", "key", "lo"]][1:] != stays[["m", "c", "d", "key", "lo"]][:-1])])]
        out = [(bucket, -1, True, _pack(stays))] + [(bucket, c, False, x) for c, x in _by_chunk(rows[~original], chunks)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SIFTED, strict=True)], schema=_SIFTED)

    return run


_JUDGED = pa.schema([("chunk", pa.int64()), ("wanted", pa.bool_()), ("data", pa.binary())])


def _judge(chunks: int):
    """Of the contexts of a bucket: which are copies of an earlier one, and which must be looked at."""

    def run(table: pa.Table) -> pa.Table:
        rows, new_group, new, original = _ordered(table)
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_group))[np.cumsum(new_group) - 1]
        out = [(c, True, x) for c, x in _by_chunk(rows[new & ((kinds > 1) | rows["inner"])], chunks)] + [(c, False, x) for c, x in _by_chunk(rows[~original], chunks)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _JUDGED, strict=True)], schema=_JUDGED) if out else _JUDGED.empty_table()

    return run


_TAKEN = pa.schema([("bucket", pa.int64()), ("m", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())])


def _fetch(buckets: int):
    """The bytes of the wanted contexts."""

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not docs.num_rows or not wanted.num_rows:
            return _TAKEN.empty_table()
        docs = docs.combine_chunks()
        texts = dict(zip(docs.column("key").to_pylist(), as_bytes(docs.column("text").combine_chunks()), strict=True))
        rows = np.concatenate([_unpack(x) for x in wanted.column("data").to_pylist()])
        data = [texts[k][a : a + s] for k, a, s in zip(rows["key"].tolist(), rows["lo"].tolist(), rows["size"].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array((rows["m"] % np.uint64(buckets)).astype(np.int64)), pa.array(rows["m"].view(np.int64)), pa.array(rows["key"]), pa.array(rows["lo"]), pa.array(data, pa.binary())], schema=_TAKEN)

    return run


def repeated_windows(parts: list[bytes], keys: np.ndarray, los: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(part, offset) of the windows that also start earlier; parts stand anywhere in their documents."""
    total = sum(map(len, parts)) + len(parts)
    text = np.zeros(total, np.int64)
    owner, offset, at = [], [], 0
    for i, p in enumerate(parts):
        text[at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) + 2
        text[at + len(p)] = 1
        owner.append(np.full(len(p) + 1, i))
        offset.append(np.arange(len(p) + 1))
        at += len(p) + 1
    owner, offset = np.concatenate(owner), np.concatenate(offset)
    sizes = np.array(list(map(len, parts)))
    whole = offset + length <= sizes[owner]
    windows = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), length) if total >= length else None
    order = np.array(suffix_array(text.tolist()), np.int64)
    order = order[whole[order]]
    if not len(order):
        return []
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 4096):
        b = min(len(order), a + 4096)
        same[a:b] = (windows[order[a:b]] == windows[order[a - 1 : b - 1]]).all(1)
    run = np.cumsum(~same)
    where = los[owner[order]] + offset[order]
    key = keys[owner[order]]
    by = np.lexsort((where, key, run))
    first = np.concatenate([[True], run[by][1:] != run[by][:-1]])
    later = order[by[~first]]
    return list(zip(owner[later].tolist(), offset[later].tolist(), strict=True))


def _recurring(parts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, start, end) of the stretches whose windows hold no gram that the parts have only once. No other window can be repeated."""
    sizes = np.array(list(map(len, parts)), np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts)), sizes)
    first = np.cumsum(sizes) - sizes
    g = grams(raw, gram)
    left = np.repeat(sizes, sizes) - (np.arange(len(raw)) - first[owner])
    whole = left[: len(g)] >= gram
    order = np.argsort(g, kind="stable")
    order = order[whole[order]]
    same = g[order[1:]] == g[order[:-1]]
    again = np.zeros(len(raw) + 1, np.int64)
    again[order[1:][same]] = again[order[:-1][same]] = 1
    sums = np.concatenate([[0], np.cumsum(again)])
    width = length - gram + 1
    starts = np.flatnonzero(left >= length)
    starts = starts[sums[starts + width] - sums[starts] == width]
    if not len(starts):
        return starts, starts, starts
    new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(owner[starts]) != 0)])
    a, b = starts[new], starts[np.concatenate([np.flatnonzero(new)[1:], [len(starts)]]) - 1]
    return owner[a], a - first[owner[a]], b - first[owner[a]] + length


def covered(m: np.ndarray, key: np.ndarray, lo: np.ndarray, data: list[bytes], length: int, gram: int, dealt: int = 0) -> Iterator[tuple[int, int, int]]:
    """(key, start, size) of the repeated windows of parts of documents, hash by hash; equal windows have equal hashes ``m``."""
    part, a, b = _recurring(data, length, gram)
    m, key, lo = m[part], key[part], lo[part] + a
    data = [data[i][x:y] for i, x, y in zip(part.tolist(), a.tolist(), b.tolist(), strict=True)]
    # Equal stretches in order of their place: all but the first are copies.
    seen: set[tuple[int, bytes]] = set()
    distinct = []
    for i in np.lexsort((lo, key, m)).tolist():
        if (m[i], data[i]) in seen:
            yield int(key[i]), int(lo[i]), len(data[i])
        else:
            seen.add((m[i], data[i]))
            distinct.append(i)
    start = 0
    while start < len(distinct):
        size, stop = 0, start
        while stop < len(distinct):
            end, more = stop, 0
            while end < len(distinct) and m[distinct[end]] == m[distinct[stop]]:
                more += len(data[distinct[end]]) + 1
                end += 1
            if size and size + more > SORTED:
                break
            size, stop = size + more, end
        own = distinct[start:stop]
        start = stop
        if size > LARGE and dealt < DEALT:
            finer = [(x, int(key[i]), int(lo[i]) + y, data[i][y : y + z]) for i in own for x, y, z in zip(*(c.tolist() for c in contexts(data[i], length, gram, dealt + 1)[:3]), strict=True)]
            by, keys, los, pieces = zip(*finer, strict=True)
            yield from covered(np.array(by, np.uint64), np.array(keys, np.int64), np.array(los, np.int64), list(pieces), length, gram, dealt + 1)
            continue
        found = sorted(repeated_windows([data[i] for i in own], key[own], lo[own], length))
        # Consecutive windows of a stretch cover one range.
        at = 0
        while at < len(found):
            end = at
            while end + 1 < len(found) and found[end + 1] == (found[at][0], found[end][1] + 1):
                end += 1
            i = own[found[at][0]]
            yield int(key[i]), int(lo[i]) + found[at][1], found[end][1] + length - found[at][1]
            at = end + 1


def _sort(length: int, gram: int, chunks: int):
    """Suffix-sorts the contexts of a bucket; the repeated windows as covered ranges."""

    def run(table: pa.Table) -> pa.Table:
        m, key, lo = (np.asarray(table.column(k).combine_chunks()) for k in ("m", "key", "lo"))
        covers = list(covered(m, key, lo, table.column("bytes").to_pylist(), length, gram))
        if not covers:
            return _JUDGED.empty_table()
        rows = np.zeros(len(covers), _ANCHOR)
        rows["key"], rows["lo"], rows["size"] = zip(*covers, strict=True)
        out = [(c, False, x) for c, x in _by_chunk(rows, chunks)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _JUDGED, strict=True)], schema=_JUDGED)

    return run


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remove(schema: pa.Schema):
    def run(docs: pa.Table, covers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs = docs.combine_chunks()
        rows = np.concatenate([_unpack(x) for x in covers.column("data").to_pylist()] or [np.zeros(0, _ANCHOR)])
        rows = rows[np.argsort(rows["key"], kind="stable")]
        keys = docs.column("key").to_pylist()
        a, b = np.searchsorted(rows["key"], keys), np.searchsorted(rows["key"], keys, "right")
        sizes, spans, kept = [], [], []
        for i, data in enumerate(as_bytes(docs.column("text").combine_chunks())):
            own = rows[a[i] : b[i]]
            gone = merged(own["lo"], own["lo"] + own["size"].astype(np.int64))
            at, left = 0, []
            for x, y in gone:
                left.append(data[at:x])
                at = y
            sizes.append(len(data))
            spans.append([{"start": x, "end": y} for x, y in gone])
            kept.append(b"".join([*left, data[at:]]))
        return pa.Table.from_arrays([docs.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary())], schema=schema)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text); keys are unique longs in the order of the documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    odd = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1)
    if odd.isEmpty() and dict(rows.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        return rows.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = rows.select("doc_id", "tie").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "tie").select(F.col("doc_id").alias("of"), F.col("tie").alias("with"), F.monotonically_increasing_id().alias("key"))
    keys = materialize(keys, "keys")
    return rows.join(keys, rows["doc_id"].eqNullSafe(keys["of"]) & (rows["tie"] == keys["with"])).select("key", "doc_id", "text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row: the removed ranges of bytes, and what is left."""
    rows = _keyed(docs, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(LEAST_CHUNKS, -(-size // chunk_bytes))
    forget(docs.sparkSession)
    buckets, parts = max(LEAST_CHUNKS, chunks // BUCKET_CHUNKS), -(-chunks // MEETING)
    found = rows.select("key", "text").mapInArrow(_scan(length, gram, buckets, parts), "bucket long, part long, data binary")
    copies = None
    if parts > 1:
        sifted = materialize(found.groupBy("bucket", "part").applyInArrow(_sift(chunks), "bucket long, chunk long, wanted boolean, data binary"), "sifted")
        found, copies = sifted.filter("wanted").select("bucket", "data"), sifted.filter("not wanted").select("chunk", "wanted", "data")
    judged = materialize(found.groupBy("bucket").applyInArrow(_judge(chunks), "chunk long, wanted boolean, data binary"), "judged")
    forget(docs.sparkSession)
    dealt = rows.select(F.pmod(F.hash("key"), F.lit(chunks)).cast("long").alias("chunk"), "key", "doc_id", "text")
    taken = dealt.groupBy("chunk").cogroup(judged.filter("wanted").groupBy("chunk")).applyInArrow(_fetch(buckets), "bucket long, m long, key long, lo long, bytes binary")
    sorted_ = taken.groupBy("bucket").applyInArrow(_sort(length, gram, chunks), "chunk long, wanted boolean, data binary")
    covers = judged.filter("not wanted").unionByName(sorted_)
    covers = covers if copies is None else covers.unionByName(copies)
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    return dealt.groupBy("chunk").cogroup(covers.groupBy("chunk")).applyInArrow(_remove(schema), f"doc_id {kind.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
