"""The corpus operators as registered queries over whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opstables.llm import bpe, classifier, conversations, exact, lines, packing, quality_rules, secrets, sharding, simhash, spelling, substrings, warc
from opstables.llm.common import documents, stored


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("text_key")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.interleaved_shards(documents(spark, sf_dir), 16)
    return shards.select(
        "doc_id", F.col("text_size").alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.find_secrets(docs, owner=docs["source"], repo=F.concat_ws("/", docs["source"], docs["lang"]))

    def n(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long").alias(f"n_{value}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        *(n("kind", kind) for kind in secrets.BASE_KINDS),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
        *(n("verdict", verdict) for verdict in ("example", "live", "unclear")),
        # of the document's values, the most widely held
        *(F.coalesce(F.array_max(F.col(f"spans.n_{c}")), F.lit(0)).cast("long").alias(f"most_{c}") for c in ("owners", "repos")),
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers  # only this operator needs it

    ranks = bpe.load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    decoded = bpe.round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(documents(spark, sf_dir), digests=True)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = quality_rules.quality_verdicts(documents(spark, sf_dir), show=base)
    too_short, repeats = (rule.hit({c: F.col(c) for c in base}) for rule in quality_rules.BASE_RULES)
    return found.select("doc_id", *base, (too_short | repeats).alias("base_failed"), "kept")


#: Scores from here on count as good.
QUALITY_THRESHOLD = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> classifier.Model:
    """Trained on the labels of rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return classifier.train(docs, labels)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = classifier.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = conversations.damaged(given)
    audits = stored(conversations.audits(rows), "audits")
    texts = conversations.digests(conversations.repaired(rows, audits))
    by_conv = lambda df: df.withColumn("conv", F.col("conv_id")).drop("conv_id")
    out = given.select("conv_id").distinct()
    for found in (by_conv(audits), by_conv(texts)):
        out = out.join(found, out["conv_id"].eqNullSafe(found["conv"]), "left").drop("conv")
    counts = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_records(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_sharding, op3_secret_scans, op4_simhash_near_dedup, op5_byte_level_bpe, op6_substring_dedup, op7_exact_dedup, op8_line_dedup, op9_quality_rules, op10_quality_classifier, op11_conversation_repair, op12_warc, op13_spelling_variants)
}

# crc32 by the usual table of 256 entries, built from its polynomial
ORACLES: dict[str, str] = {
    "op2_sharding": """
WITH crc_table AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(0, 8) AS BIGINT[])),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src, coalesce(text, '') AS txt,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), sized AS (
  SELECT doc_id, src, no_src, h, CAST(strlen(txt) + 1 AS BIGINT) AS size,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(txt)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
             lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]))) AS text_crc32
  FROM d, crc_table
), ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY src, no_src ORDER BY h, doc_id, text_crc32, size) - 1) / CAST(2 * count(*) OVER (PARTITION BY src, no_src) AS DOUBLE) AS frac
  FROM sized
), placed AS (
  SELECT *, row_number() OVER (ORDER BY frac, h, src, no_src, doc_id, text_crc32, size) - 1 AS p, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((p * 16) // n AS INT) AS shard,
       CAST(p - (((p * 16) // n) * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed
""",
    "op6_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: md5(array_to_string(ws[i:i + 12], ' ')))) AS k FROM w
), windows AS (
  SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY k) AS copied FROM places
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows WHERE copied
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (g.i IS NULL) AS txt
  FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       coalesce(doc_id = max(doc_id) OVER same, doc_id IS NULL AND max(doc_id) OVER same IS NULL) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keys AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), judged AS (
  SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM keys
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op9_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS txt, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM places
), steps AS (
  SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS step FROM twice WHERE n > 1
), covered AS (
  SELECT doc_id, CAST(sum(step) AS BIGINT) AS n FROM steps GROUP BY doc_id
), f AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(txt, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(regexp_extract_all(txt, '[!?]')) AS n_marks, len(regexp_extract_all(txt, '\p{Lu}')) AS n_upper, len(string_split(txt, chr(10))) AS n_lines
  FROM (SELECT *, list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w) LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * n_marks > 10 * word_chars OR 100 * n_upper > 60 * word_chars
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)) AS kept
FROM b
""",
    "op12_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND (page_id IS NULL OR page_id > first) AS again FROM p)
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(0, 8) AS BIGINT[])),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
         lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]))) AS h
  FROM counted, crc_table
), damaged AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
), judged AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), followed AS (
  SELECT word, word AS root, n FROM judged
  UNION ALL SELECT f.word, j.form, j.form_n FROM followed f JOIN judged j ON f.root = j.word WHERE j.form IS NOT NULL
)
SELECT j.word, form, root, j.n, n_near, form_n FROM judged j JOIN (SELECT word, max_by(root, n) AS root FROM followed GROUP BY word) USING (word)
""",
}
