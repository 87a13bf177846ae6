"""Queries over what SQL can express of the training-data operators, and the SQL that checks them.

Operators whose whole result SQL can express have their SQL under their own name. Of the others these queries give the part that it can.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .digests import compare_edited
from .licenses import phrase_columns, scan_phrases
from .ngrams import score_texts
from .secrets import op8_secrets
from .whitening import op12_whitening

_WORD = r"[^\x20\x09-\x0D]+"


def digest_texts(spark, sf_dir: str):
    """Of the fingerprints' query, the sizes and the edited texts' hashes."""
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_chars", "edited_sha256")


def secret_base(spark, sf_dir: str):
    """Of the secrets' query, what the plain patterns find."""
    return op8_secrets(spark, sf_dir).drop("spans")


def ngram_base(spark, sf_dir: str):
    """Of the scores' query, counts and the add-one unigram score."""
    out = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def license_base(spark, sf_dir: str):
    """Of the licences' query, words and places of the phrases."""
    out = scan_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *phrase_columns())


def whitening_base(spark, sf_dir: str):
    """Of the whitening's query, the different vectors and each one's exact deviation; of the components, how many there are."""
    return op12_whitening(spark, sf_dir).groupBy("vec_id").agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("n"), F.max("deviation").alias("deviation"), F.max(F.col("identity_error") <= 0.0001).alias("white"))


QUERIES = {"ext_digest_texts": digest_texts, "ext_secret_base": secret_base, "ext_ngram_base": ngram_base, "ext_license_base": license_base, "ext_whitening_base": whitening_base}

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_CRC = """crc AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i)), crcs AS (SELECT list(v ORDER BY i) AS tab FROM crc)"""
_FOLD = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 7"

SQL = {
    # words are runs of ASCII letters and digits and of other scripts' characters; both sides compare distinct five-word shingles
    "op2_decontaminate": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents), wi AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark WHERE text IS NOT NULL),
      ti AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS shingles, least(len(ws), 5) AS n FROM wi WHERE len(ws) > 0),
      si AS (SELECT item_id, n, len(shingles) AS size, unnest(shingles) AS s FROM ti), ns AS (SELECT DISTINCT n FROM ti),
      sd AS (SELECT DISTINCT doc_id, n, s FROM (SELECT doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS s FROM w, ns) WHERE s IN (SELECT s FROM si))
      SELECT doc_id, item_id, count(*) AS shared, CAST(any_value(size) AS BIGINT) AS item_shingles, count(*) / any_value(size)::DOUBLE AS containment FROM sd JOIN si USING (n, s) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(size) - 1e-9""",
    "op6_substrings": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents), p AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM d WHERE len(ws) >= 20),
      k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM p), g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
      c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM g), r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id), x AS (SELECT d.doc_id, ws, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id)),
      u AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d), kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS t FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY u.doc_id)
      SELECT x.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM x LEFT JOIN kept ON kept.doc_id = x.doc_id""",
    "op7_warc": f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM p),
      b AS (SELECT *, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda j: substr({_BASE32}, CAST((CAST('0x' || substr(s, CAST(g * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * j AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '')), '') AS digest, row_number() OVER (PARTITION BY page_id) AS k FROM f)
      SELECT page_id, strlen(h) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to, url AS uri, true AS intact FROM b""",
    "ext_digest_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM d)
      SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || CASE WHEN length(t) < 2 THEN '' ELSE left(after, length(t) // 2) END) AS edited_sha256 FROM n""",
    "ext_secret_base": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT * FROM (VALUES (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 6), (1, 'access', 'AKIA[A-Z0-9]+', 20), (2, 'hex', '[0-9a-f]+', 24)) v(o, kind, p, least)),
      m AS (SELECT doc_id, o, kind, least, regexp_extract_all(t, p) AS f, regexp_split_to_array(t, p) AS b FROM d, k), u AS (SELECT doc_id, o, kind, least, f, b, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0),
      s AS (SELECT doc_id, o, kind, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(f[i]) AS n, CASE WHEN kind = 'assign' THEN length(regexp_extract(f[i], '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) ELSE length(f[i]) END AS size, least FROM u)
      SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o), '')) AS base_sha256 FROM d LEFT JOIN (SELECT * FROM s WHERE size >= least) s USING (doc_id) GROUP BY d.doc_id""",
    "ext_ngram_base": rf"""WITH {_CRC}, d AS (SELECT doc_id, {_FOLD} = 2 AS held, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS ws FROM documents, crcs),
      t AS (SELECT doc_id, held, unnest(ws) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w), z AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
      SELECT doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(*) FILTER (coalesce(c, 0) > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::DOUBLE)), 3) AS base_score FROM t LEFT JOIN c USING (w), z GROUP BY doc_id""",
    "ext_license_base": r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
      p AS (SELECT doc_id, ws, list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + 4] = ['under', 'the', 'mit', 'license']) AS m, list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + 4] = ['apache', 'license', 'version', '2']) AS a, list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + 3] = ['cc', 'by', 'nc']) AS c FROM w)
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(m) + len(a) + len(c) AS BIGINT) AS n_base, list_min(m || a || c) AS first_word, list_max(m || a || c) AS last_word,
        array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'apache-2' END, CASE WHEN len(c) > 0 THEN 'cc-by-nc' END, CASE WHEN len(m) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p""",
    "ext_whitening_base": """WITH r AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
      f AS (SELECT DISTINCT x FROM r), z AS (SELECT count(*) AS n FROM f), u AS (SELECT unnest(range(1, len(x) + 1)) AS k, unnest(x) AS c FROM f), s AS (SELECT list(t ORDER BY k) AS tot FROM (SELECT k, CAST(sum(c) AS BIGINT) AS t FROM u GROUP BY k))
      SELECT vec_id, CAST(4 AS BIGINT) AS components, n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda k: (n * x[k] - tot[k]) * (n * x[k] - tot[k]))) AS BIGINT) AS deviation, true AS white FROM r, z, s""",
}
