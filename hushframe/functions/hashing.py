"""64-bit hashes, salted seeds and sticky random numbers as native expressions.

A 64-bit word is a pair of columns ``hi`` and ``lo``, each a bigint of 32 bits, so words order as unsigned numbers do and no product
overflows under ANSI.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of FNV-1a.
OFFSET, PRIME = 14695981039346656037, 1099511628211
_LOW = 0xFFFFFFFF


class Word(NamedTuple):
    hi: Column
    lo: Column

    def __xor__(self, other):
        if isinstance(other, int):
            other = literal(other)
        return Word(self.hi.bitwiseXOR(other.hi), self.lo.bitwiseXOR(other.lo))

    def struct(self) -> Column:
        return F.struct(self.hi.alias("hi"), self.lo.alias("lo"))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def of(struct: Column) -> Word:
    return Word(struct["hi"], struct["lo"])


def literal(x: int) -> Word:
    return Word(F.lit(x >> 32).cast("long"), F.lit(x & _LOW).cast("long"))


def fnv(data: bytes | str) -> int:
    h = OFFSET
    for b in data.encode() if isinstance(data, str) else data:
        h = (h ^ b) * PRIME % (1 << 64)
    return h


def _step(state, byte: Column) -> dict[str, Column]:
    # The prime is 2^40 + 435: hi gets lo * 256 (from 2^40) and hi * 435, and the carry of lo * 435.
    x = state["lo"].bitwiseXOR(byte)
    low = x * 435
    hi = (state["hi"] * 435 + x * 256 + F.shiftright(low, 32)).bitwiseAND(F.lit(_LOW))
    return {"hi": hi, "lo": low.bitwiseAND(F.lit(_LOW))}


def _fold(octets: Column) -> Column:
    return F.aggregate(octets, literal(OFFSET).struct(), lambda state, byte: F.struct(*(c.alias(n) for n, c in _step(state, byte).items())))


def fnv_text(text: Column) -> Column:
    """Of the UTF-8 bytes of a string column; a struct of hi and lo."""
    digits = F.hex(F.encode(text, "UTF-8"))
    octet = lambda d: lambda i: F.conv(F.substring(d, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    octets = lambda d: F.transform(F.sequence(F.lit(1), F.floor(F.length(d) / 2).cast("int")), octet(d))
    return _fold(let(digits, lambda d: F.when(F.length(d) > 0, octets(d)).otherwise(F.array().cast("array<bigint>"))))


def fnv_long(number: Column) -> Column:
    """Of the eight little-endian bytes of a bigint column; a struct of hi and lo."""
    return _fold(F.array(*(F.shiftright(number, 8 * i).bitwiseAND(F.lit(255)) for i in range(8))))


def with_fnv_long(df: DataFrame, number: Column, into: str) -> DataFrame:
    """Adds ``into``: the same hash as ``fnv_long``, a byte a projection, so that all of it is compiled with the steps around it."""
    hi, lo, n = "__hi", "__lo", "__n"
    out = df.withColumns({n: number, hi: F.lit(OFFSET >> 32).cast("long"), lo: F.lit(OFFSET & _LOW).cast("long")})
    for i in range(8):
        step = _step({"hi": F.col(hi), "lo": F.col(lo)}, F.shiftright(n, 8 * i).bitwiseAND(F.lit(255)))
        out = out.withColumns({hi: step["hi"], lo: step["lo"]})
    return out.withColumn(into, F.when(F.col(n).isNotNull(), F.struct(F.col(hi).alias("hi"), F.col(lo).alias("lo")))).drop(n, hi, lo)


def xor_all(words: Column) -> Column:
    """Of an array of hi/lo structs; a struct."""
    return F.aggregate(words, literal(0).struct(), lambda a, b: (of(a) ^ of(b)).struct())


def _swapped(word: Word) -> Column:
    """Sixteen hex digits of the eight bytes, the lowest first."""
    digits = F.concat(F.lpad(F.hex(word.hi), 8, "0"), F.lpad(F.hex(word.lo), 8, "0"))
    return F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2)))


def crypt(salt: bytes, seed: Word) -> Column:
    """The first eight bytes of SHA-256 over salt and seed, little-endian both ways; a struct of hi and lo."""

    def word(digest: Column) -> Column:
        part = lambda at: F.conv(F.concat(*(F.substring(digest, i, 2) for i in range(at + 6, at - 1, -2))), 16, 10).cast("long")
        return Word(part(9), part(1)).struct()

    return let(F.sha2(F.concat(F.lit(salt), F.unhex(_swapped(seed))), 256), word)


def uniform(lower: Column, upper: Column, seed: Word) -> Column:
    return lower + seed.hi.bitwiseXOR(seed.lo) % (upper - lower + 1)


def normal(sd: Column, seed: Word) -> Column:
    u, v = seed.lo / F.lit(float(_LOW)), seed.hi / F.lit(float(_LOW))
    # A seed without low bits has an infinite value; any bound on it would do.
    u = F.greatest(u, F.lit(1e-300))
    return sd * F.sqrt(-2.0 * F.log(u)) * F.sin(2 * math.pi * v)


def noise(salt: bytes, step: str, sd: Column, layers: list[Word]) -> Column:
    out = F.lit(0.0)
    for layer in layers:
        out = out + let(crypt(salt, layer), lambda c: normal(sd, of(c) ^ fnv(step)))
    return F.when(sd == 0, F.lit(0.0)).otherwise(out)


def crypt_number(salt: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.sha256(salt + seed.to_bytes(8, "little")).digest()[:8], "little")
