import random
import re

import corpus_pipeline
from hushframe.llm import decontaminate as dc


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, min_items=2):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            x = words(t)
            n = min(8, len(x))
            windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found), len(found) >= min_items))
    return sorted(out, key=str)


def got(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found.collect()), key=str)


def test_hits_are_those_of_brute_force(spark, text_of):
    rng = random.Random(4)
    items = [(i, text_of(100 + i, rng.randint(1, 30))) for i in range(20)] + [(20, None), (21, "..."), (10, text_of(110, 12)), (22, "Zürich, 9th!")]
    docs = []
    for i in range(60):
        own = [text_of(i, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            t = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(t) - 8))
            own += [" ".join(t[a : a + rng.randint(1, 20)]).upper(), text_of(rng.random(), rng.randint(0, 9))]
        docs.append((i, "; ".join(own)))
    docs += [(60, None), (61, ""), (None, items[3][1]), (62, "zürich 9th"), (62, "zürich 9th")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, items string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, fp int")
    assert got(dc.decontaminate(df, bench)) == brute(docs, items)


def test_odd_tables(spark, odd, odd_rows, empty):
    bench = spark.createDataFrame([(1, odd_rows[0][1]), (2, "word"), (None, "a b")], "item_id long, text string")
    # An item without an id is not counted among the items.
    assert len(got(dc.decontaminate(odd, bench))) == len(odd_rows)
    assert dc.decontaminate(empty, bench).count() == 0
    assert {r[2] for r in got(dc.decontaminate(odd, bench.filter("false")))} == {0}


def test_stage_removes_a_document_with_one_item(spark, text_of, tmp_path):
    item, clean = text_of("item", 20), text_of("clean", 100)
    spark.createDataFrame([(1, item), (2, "rare")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, clean), (2, f"{clean} {item}"), (3, " ".join(item.split()[3:11])), (4, " ".join(item.split()[3:10])), (5, "a rare word"), (6, None), (7, f"rare {item}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.decontamination(spark, df, str(tmp_path)).collect()) == [1, 4, 5, 6]


def test_fingerprints_are_selected_and_every_shared_span_has_one(text_of):
    a = text_of("left", 40) + " " + text_of("shared", dc.SPAN) + " " + text_of("tail", 30)
    b = text_of("other", 33) + " " + text_of("shared", dc.SPAN) + " " + text_of("end", 50)
    long = dc.Texts([text_of("long", 50_000).encode()])
    at, _ = long.selected(dc.SPAN, False)
    assert len(at) < 0.4 * 50_000  # two for every six grams, not one for every span
    for x, y in ((a, b), (b, a), ("the " * 9, "the " * 20)):
        fps = [set(dc.Texts([t.encode()]).selected(dc.SPAN, False)[1].tolist()) for t in (x, y)]
        assert fps[0] & fps[1]


def test_spans_at_every_offset_are_found(spark, text_of):
    """Hits end where the words differ, however little is shared beyond the span, and repeated words within a span."""
    item = text_of("item", 30).split()
    docs = [(1000 * n + i, " ".join(["xx"] * j + item[i : i + n] + ["yy"] * 9)) for n in (7, 8, 9, 13) for i in range(30 - n) for j in (0, 3)]
    docs += [(-1, "ab " * 12 + "cd"), (-2, "cd " + "ab " * 7), (-3, "ab " * 8)]
    items = [(1, " ".join(item)), (2, "ab " * 10), (3, "cd ef")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(dc.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_empty_tables_in_the_stage(spark, empty, odd, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.decontamination(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.decontamination(spark, odd, str(tmp_path)).count() == odd.count()
