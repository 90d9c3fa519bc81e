"""Queries over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import backoff_lm, decontaminate, language_id, line_crf, mixing, passage_attention, shard_tree, simhash, suffix_dedup, warc
from hushframe.llm.common import crc_mod, materialize, table


def op1_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, crc_mod("doc_id", 4) != 2).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_tree.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = line_crf.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc.doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_content_words")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_passage_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = passage_attention.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(mixing.sized(table(spark, sf_dir, "documents")).select("id", "source", "size"), "sizes")
    return mixing.mix(sizes).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages"))).filter("gap is null")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES = {
    "op1_backoff_lm": op1_backoff_lm,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_shard_tree": op4_shard_tree,
    "op5_line_crf": op5_line_crf,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_passage_attention": op7_passage_attention,
    "op8_systematic_mix": op8_systematic_mix,
    "op9_warc_salvage": op9_warc_salvage,
    "op10_winnowing": op10_winnowing,
}

_H48 = "CAST(('0x' || substr(md5({}), 1, 12)) AS BIGINT)"
_ID = "coalesce(CAST(doc_id AS VARCHAR), '')"


def _draws(n: int) -> str:
    return ", ".join(f"-ln((CAST({_H48.format(f"concat('{shard_tree.SEED}:{s}:', {_ID})")} AS DOUBLE) + 0.5) / CAST({1 << 48} AS DOUBLE)) AS d{s}" for s in range(n))


def _nearest(n: int) -> str:
    return f"CAST(list_position([{', '.join(f'd{s}' for s in range(n))}], least({', '.join(f'd{s}' for s in range(n))})) - 1 AS INTEGER)"


ORACLES: dict[str, str] = {
    "op4_shard_tree": f"""WITH steps AS (SELECT n, list_reduce(list_prepend(n::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS t FROM range(256) r(n)),
tab AS (SELECT list(t ORDER BY n) AS l FROM steps),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, {_draws(9)}, {_H48.format(f"concat('slot:', {_ID})")} AS cell FROM documents),
s AS (SELECT *, {_nearest(8)} AS shard, {_nearest(9)} AS grown_shard FROM d)
SELECT doc_id, octet_length(b) + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(b) + 1), lambda i: CAST(('0x' || substr(hex(b), 2 * i - 1, 2)) AS BIGINT))), lambda a, x: xor(a >> 8, l[xor(a & 255, x) + 1])), 4294967295::BIGINT) AS text_crc32,
'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell % {shard_tree.CELLS}, cell // {shard_tree.CELLS} % {shard_tree.CELLS}, doc_id) - 1 AS slot, grown_shard FROM s, tab""",
    "op8_systematic_mix": rf"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(CAST(rest AS DOUBLE) / free) OVER () * w) AS target FROM o),
c AS (SELECT *, size % CAST(pow(10, greatest(length(CAST(size AS VARCHAR)) - 2, 0)) AS BIGINT) - size AS coarse, {_H48.format(f"concat('{mixing.SEED}:', {_ID})")} % {mixing.CELLS} AS fine FROM d),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coarse, fine, size DESC, doc_id) - 1 AS i FROM c),
j AS (SELECT i.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e, CAST({_H48.format(f"concat('{mixing.SEED}:offset:', coalesce(i.source, ''))")} % {1 << 32} AS DOUBLE) / CAST({1 << 32} AS DOUBLE) AS u FROM i JOIN t ON i.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor((i + 1) * e + u) - floor(i * e + u) AS BIGINT) * size AS taken FROM j""",
    "op9_warc_salvage": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m""",
    "op10_winnowing": r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, least(len(w), 8) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS u(i)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM bw) AS lengths, unnest(range(1, len(w) - n + 2)) AS u(i)),
h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, k)),
p AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM h, unnest(range(i, i + n)) AS u(spot) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
