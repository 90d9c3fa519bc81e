from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe.functions import hashing as H


def number(word):
    word = H.of(word)
    return (word.hi.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + word.lo).cast("decimal(20,0)")


def test_golden_values(spark):
    row = spark.range(1).select(
        number(H.fnv_text(F.lit("Paul"))), number(H.fnv_text(F.lit(""))), number(H.fnv_long(F.lit(1).cast("long"))), number(H.crypt(b"", H.literal(0))), number(H.crypt(b"salt", H.literal(1))),
        H.uniform(F.lit(2), F.lit(5), H.of(H.crypt(b"", H.literal(0))) ^ H.fnv("outlier")), H.noise(b"", "noise", F.lit(1.0), [H.literal(0)]),
    ).first()
    assert [int(x) for x in row[:6]] == [3338873877283044659, 14695981039346656037, 9929646806074584996, 8794265229978523055, 8909765147153334387, 5]
    assert abs(row[6] - 0.9945808115947429) < 1e-12


def test_texts_hash_as_in_python(spark):
    texts = ["", "a", "Zoë", "日本", "x" * 50, "\x00\x01"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", number(H.fnv_text(F.col("t"))).alias("h")).collect()
    assert all(int(r["h"]) == H.fnv(r["t"]) for r in rows)


def test_numbers_hash_as_eight_bytes(spark):
    numbers = [0, 1, -1, 2**63 - 1, -(2**63), 1234567890123]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", number(H.fnv_long(F.col("n"))).alias("h")).collect()
    assert all(int(r["h"]) == H.fnv(r["n"].to_bytes(8, "little", signed=True)) for r in rows)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_fnv_is_within_a_word(a, b):
    assert 0 <= H.fnv(a.to_bytes(8, "little")) < 1 << 64
    assert H.crypt_number(b"s", a) != H.crypt_number(b"s", b) or a == b
