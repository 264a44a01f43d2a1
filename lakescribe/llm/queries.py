"""Queries over the driver's tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, lm, merkle, mixing, near_dedup, packing, pii, quality, toxicity, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(scan: DataFrame) -> DataFrame:
    """A bare scan with fewer splits than there are cores (a small file of one row group) is dealt over the cores."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.cluster(_spread(_table(spark, sf_dir, "documents")))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_spread(_table(spark, sf_dir, "pages"))).withColumn("n_chars", F.length("text").cast("long"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(_table(spark, sf_dir, "documents"))
    found = pii.find(docs, pii.train(docs))

    def listed(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _spread(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.filter(toxicity.remainder(F.col("doc_id"), 4) != 2))
    scored = toxicity.with_score(docs.select("doc_id", "text"), machine)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", (toxicity.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", predicted.alias("predicted"))


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of (doc_id, tokens, decoded)."""
    joined = F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")
    return encoded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _spread(_table(spark, sf_dir, "documents"))
    return digests(bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_spread(_table(spark, sf_dir, "documents"))).drop("rejected_by")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(_table(spark, sf_dir, "documents"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(_table(spark, sf_dir, "documents"))
    scored = lm.score(docs, docs.filter(toxicity.remainder(F.col("doc_id"), 5) != 1))
    held_out = (toxicity.remainder(F.col("doc_id"), 5) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pieces(_spread(_table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf_hash(*[F.col(c) for c in fields[:-1]], lowered)
    manifest = merkle.build(_spread(_table(spark, sf_dir, "documents")), altered=F.when(F.col("doc_id").isNotNull() & (toxicity.remainder(F.col("doc_id"), 5) == 0), tampered))
    found = merkle.proofs(manifest, full=False).withColumnRenamed("id", "doc_id")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_spread(_table(spark, sf_dir, "embeddings"))).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_html_text": op2_html_text,
    "op3_url_filter": op3_url_filter,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_lm": op10_lm,
    "op11_packing": op11_packing,
    "op12_merkle": op12_merkle,
    "op13_whitening": op13_whitening,
}

OP3_SQL = r"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
outcome AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
counted AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM split LEFT JOIN outcome ON page_id = doc_id GROUP BY host),
parts AS (SELECT *, string_split(name, '.') AS p, list_contains(@SUFFIXES@, array_to_string(list_slice(string_split(name, '.'), -2, -1), '.')) AS two FROM counted),
hosts AS (
  SELECT host, n, bad, CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN name ELSE array_to_string(list_slice(p, CASE WHEN two THEN -3 ELSE -2 END, -1), '.') END AS domain,
         CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN name ELSE array_to_string(list_slice(p, CASE WHEN two THEN -2 ELSE -1 END, -1), '.') END AS suffix FROM parts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
spread AS (
  SELECT up, sum(bad) AS b, sum(n) AS t, count(*) AS k, sum(bad * bad / n) AS sq, sum(n * n) AS nn FROM (
    SELECT 's' AS up, n, bad FROM suffixes WHERE n > 0
    UNION ALL SELECT 'd.' || suffix, n, bad FROM domains WHERE n > 0
    UNION ALL SELECT 'h.' || domain, n, bad FROM hosts WHERE n > 0) GROUP BY up),
variance AS (SELECT up, k, t, (b / t) * (1 - b / t) AS noise,
         CASE WHEN t - nn / t > 0 THEN (sq - b * (b / t) - (k - 1) * (b / t) * (1 - b / t)) / (t - nn / t) END AS v FROM spread),
strength AS (SELECT up, least(greatest(coalesce(CASE WHEN k > 1 AND v > 0 THEN noise / v - 1 END, 200), 4), greatest(least(t, 200), 4)) AS m FROM variance),
overall AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS mean FROM suffixes),
top AS (SELECT suffix, (bad + coalesce(m, 4) * mean) / (n + coalesce(m, 4)) AS mean FROM suffixes CROSS JOIN overall LEFT JOIN strength ON up = 's'),
mid AS (SELECT domain, (bad + coalesce(m, 4) * mean) / (n + coalesce(m, 4)) AS mean FROM domains JOIN top USING (suffix) LEFT JOIN strength ON up = 'd.' || suffix),
low AS (SELECT host, bad + coalesce(m, 4) * mean AS a, n - bad + coalesce(m, 4) * (1 - mean) AS b FROM hosts JOIN mid USING (domain) LEFT JOIN strength ON up = 'h.' || domain),
bound AS (SELECT host, a / (a + b) - 1.28 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM low),
ruled AS (
  SELECT page_id, host, path, CASE
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > (SELECT mean FROM overall) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN bound USING (host)
""".replace("@SUFFIXES@", str(url_filter.SUFFIXES))

OP5_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM totals),
weighted AS (SELECT *, (rk - 1) % 3 + 1 AS w, 3 * source_size AS cap, (3 * source_size)::DOUBLE / ((rk - 1) % 3 + 1) AS ratio FROM ranked),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lvl FROM weighted),
level AS (SELECT arg_min(lvl, (ratio, rk)) AS lvl FROM leveled WHERE ratio >= lvl),
targets AS (SELECT source, source_size, least(w * level.lvl, cap::DOUBLE) AS target FROM leveled CROSS JOIN level),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM rated
"""

OP9_SQL = r"""
WITH keyed AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS chars FROM documents),
best AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM keyed)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM best
"""

OP8_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM base),
win AS (
  SELECT doc_id, i, lead(w, 7) OVER o IS NOT NULL AS full_window,
         concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS v
  FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, full_window AND count(*) OVER (PARTITION BY doc_id, v, full_window) > 1 AS again FROM win),
covered AS (SELECT doc_id, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM twice),
repeats AS (SELECT doc_id, sum(hit)::BIGINT AS n_repeat_words FROM covered GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM base),
top AS (SELECT doc_id, max(c) AS top, count(*) AS n_distinct FROM (SELECT doc_id, w, count(*) AS c FROM word GROUP BY doc_id, w) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines
  FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
facts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z\x{C0}-\x{1FFF}\x{3000}-\x{FFFF}]', '', 'g')) AS n_letters,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(top, 0) AS top, coalesce(n_distinct, 0) AS n_distinct
  FROM base LEFT JOIN repeats USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN lines USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_dup_lines > 35 * n_lines OR 2 * n_upper > word_chars OR 2 * n_letters < word_chars OR 100 * top > 30 * n_words OR 100 * n_distinct < 2 * n_words) AS kept
FROM failed
"""

def _op12_sql(heights: tuple[int, int] = (6, 4)) -> str:
    """The manifest in SQL, for up to 16 ** heights[0] rows of a source and 16 ** heights[1] sources; a lone node goes up a level as it is."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bits = "list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, step: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte: {bits}), 4294967295)"
    parts = [
        f"""hashed AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, sha256({head} || {field("text")}) AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field(f"translate(text, '{upper}', '{lower}')")}) END AS altered FROM documents)""",
        "f0 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, coalesce(altered, leaf) AS cur, '' AS proof FROM hashed)",
        "t0 AS (SELECT s AS g, r AS i, leaf AS h, count(*) OVER (PARTITION BY s) AS c FROM f0)",
    ]
    for tree, height in zip("tu", heights, strict=True):
        if tree == "u":
            parts.append(f"u0 AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS c FROM t{heights[0]})")
        for k in range(height):
            parts.append(f"{tree}run{k} AS (SELECT g, i // 16 AS b, string_agg(h, '' ORDER BY i) AS run, any_value(c) AS c FROM {tree}{k} GROUP BY ALL)")
            parts.append(f"{tree}{k + 1} AS (SELECT g, b AS i, CASE WHEN c > 1 THEN sha256(run) ELSE run END AS h, count(*) OVER (PARTITION BY g) AS c FROM {tree}run{k})")
    at = 0
    for tree, height, group, index in zip("tu", heights, ("s", "0"), ("r", "s"), strict=True):
        for k in range(height):
            place = f"({index} // {16**k} % 16 * 64)::BIGINT"
            before, after = f"substr(run, 1, {place})", f"substr(run, {place} + 65)"
            new = f"CASE WHEN c > 1 THEN sha256({before} || cur || {after}) ELSE cur END AS cur, CASE WHEN c > 1 THEN proof || {before} || {after} ELSE proof END AS proof"
            parts.append(f"f{at + 1} AS (SELECT doc_id, s, r, leaf, {new} FROM f{at} JOIN {tree}run{k} ON g = {group} AND b = {index} // {16 ** (k + 1)})")
            at += 1
    return f"WITH {', '.join(parts)}\nSELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u.h AS verified FROM f{at} JOIN t{heights[0]} t ON t.g = s CROSS JOIN u{heights[1]} u"


OP12_SQL = _op12_sql()

SQL: dict[str, str] = {"op3_url_filter": OP3_SQL, "op5_mixing": OP5_SQL, "op8_quality": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op12_merkle": OP12_SQL}
