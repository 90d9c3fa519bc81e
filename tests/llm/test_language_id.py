from pyspark.sql import functions as F

from hushframe.llm import language_id as li
from hushframe.llm.common import crc_mod


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.identify(docs, crc_mod("doc_id", 4) != 2).join(docs.select("doc_id", "lang"), "doc_id").filter(crc_mod("doc_id", 4) == 2)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_odd_rows(odd, odd_rows, empty):
    got = li.identify(odd, F.lit(True)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["lang_pred"])
    assert by[3] == by[4] == by[5] == by[12] == by[13] == {"und"} and by[6] == {"de"}
    assert {x for v in by.values() for x in v} <= {"en", "de", "fr", "und"}
    assert li.identify(empty, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in li.identify(odd, F.lit(False)).collect()} == {"und"}


def test_a_text_is_the_sum_of_its_grams():
    encoder = li.Encoder()
    texts = ["abc abd", "日本語の文", "x" * 50, "no!! letters?? 12"]
    together = encoder.bundle(texts)
    for text, vector in zip(texts, together, strict=True):
        assert (li.Encoder().bundle([text])[0] == vector).all()
    letters = li._letter_vectors([32, 97])
    a, gap = letters[1], letters[0]
    import numpy as np

    # A lone letter stands between two gaps.
    assert (li.Encoder().bundle(["a"])[0] == np.roll(gap, 2) * np.roll(a, 1) * gap).all()


def test_predictions_are_those_of_brute_force(spark, odd):
    """Gram by gram: rotated letter vectors multiplied, added up, and compared by cosine."""
    import unicodedata

    import numpy as np

    vectors = {}

    def letter(c):
        if c not in vectors:
            vectors[c] = li._letter_vectors([ord(c)])[0].astype(np.float64)
        return vectors[c]

    def bundle(text):
        letters = [" "]
        for c in text + " ":
            low = c.lower() if len(c.lower()) == 1 else c
            low = low if unicodedata.category(c).startswith("L") else " "
            if low != " " or letters[-1] != " ":
                letters.append(low)
        out = np.zeros(li.DIM)
        for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
            if b != " ":
                out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return out

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang").filter("length(text) < 2000 or text is null"))
    rows = docs.withColumn("learn", F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0).collect()
    sums = {}
    own = [None if r["text"] is None else bundle(r["text"]) for r in rows]
    for r, v in zip(rows, own, strict=True):
        if r["learn"] and r["text"] is not None and r["lang"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + v / max(np.linalg.norm(v), 1e-12)
    want = []
    for r, v in zip(rows, own, strict=True):
        cosines = {k: v @ s / max(np.linalg.norm(v) * np.linalg.norm(s), 1e-12) for k, s in sums.items()} if v is not None and v.any() else {"und": 0.0}
        best = max(sorted(cosines), key=cosines.get)
        want.append((str(r["doc_id"]), best, max(0.0, cosines[best])))
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["learn"]) for r in rows], "doc_id long, text string, lang string, learn boolean")
    got = [(str(r["doc_id"]), r["lang_pred"], r["score"]) for r in li.identify(frame, F.col("learn")).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4
