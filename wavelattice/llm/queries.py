"""The queries opN_<name> of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import decontamination, language_id, licenses, line_dedup, packing, quality, simhash, substring_dedup, suffix_dedup, toxicity
from ._util import read


def fold(doc_id, modulus):
    """crc32 of doc_id as text, modulo modulus; null doc_ids are in no fold."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def op1_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    learned = labels.where(fold("doc_id", 5) != 0)
    model = toxicity.fit(docs.where(fold("doc_id", 5) != 0), learned)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", "predicted", F.size("passages").alias("n_passages"))


def language_model(docs):
    """The contract's model: learned from the folds other than 2."""
    return language_id.fit(docs.where(fold("doc_id", 4) != 2))


def op2_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_model(docs))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held, "lang_pred", "score", "rejected")


def op3_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontamination.scan_documents(docs, items, window=10).drop("spans")


def op5_suffix_array_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), width=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")


def op6_substring_dedup(spark, sf_dir):
    found = substring_dedup.remove_units(read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select(
        "doc_id", "n_units", "n_repeats", "n_removed", spans.alias("removed_spans"), F.length("kept").cast("long").alias("n_kept_chars"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)


def op8_line_dedup(spark, sf_dir):
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


def op10_packing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048).drop("ids")


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_S = quoted(quality.SPACE + "+")

OP4 = """
WITH RECURSIVE d AS (
  SELECT rowid r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws
  FROM (SELECT *, row_number() OVER () rowid FROM documents)),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(ws), 10) n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') g
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') g
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT r, count(DISTINCT p) n_hit FROM (SELECT r, unnest(range(i, i + n)) p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) n_items, string_agg(item, ',' ORDER BY item) names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, {_S}), lambda x: x <> '') ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {quoted(quality.WORD)})) full_lines FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') s FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) i FROM w)),
rep AS (SELECT r, count(DISTINCT p) n FROM (
  SELECT r, unnest(range(i, i + 8)) p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) c FROM g) WHERE c > 1) GROUP BY r),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) word_chars,
  CAST(length(regexp_replace(t, '[^{quality.SYMBOLS}]', '', 'g')) AS BIGINT) n_symbols,
  CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) n_dup_lines, coalesce(n, 0) n_repeat_words,
  CAST(length(regexp_replace(array_to_string(list_filter(full_lines, lambda x: NOT regexp_matches(x, {quoted(quality.CLOSED)})
    OR regexp_matches(lower(x), {quoted(quality.NAVIGATION)}) OR regexp_matches(lower(x), {quoted(quality.BOILERPLATE)})), ''), {_S}, '', 'g')) AS BIGINT) lost_chars
  FROM w LEFT JOIN rep USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= {quality.MAX_LOST} * word_chars AS kept
FROM f"""

def _canonical(expression):
    """licenses.canonical in DuckDB SQL."""
    out = f"lower(regexp_replace({expression}, {quoted(licenses.COPYRIGHT_LINE)}, '', 'g'))"
    for pattern, spelling in licenses.EQUIVALENT:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(spelling)}, 'g')"
    return f"md5(trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"


_KNOWN = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in [(k, t) for k, ts in licenses.NOTICES.items() for t in ts] + list(licenses.TEXTS.items()))

OP3 = f"""
WITH known AS (SELECT digest, min(license_id) license_id FROM (SELECT {_canonical("t")} digest, license_id FROM (VALUES {_KNOWN}) v(license_id, t)) GROUP BY digest),
d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
u AS (SELECT doc_id, true whole, {_canonical("t")} digest FROM d
  UNION ALL SELECT doc_id, false, {_canonical("line")} FROM (SELECT doc_id, unnest(string_split(t, chr(10))) line FROM d) WHERE length(line) >= 1)
SELECT doc_id, min(license_id) FILTER (WHERE whole) license_id,
  coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (WHERE NOT whole), '') notice_licenses,
  count(license_id) FILTER (WHERE NOT whole) n_notices, min(digest) FILTER (WHERE whole) digest
FROM u LEFT JOIN known USING (digest) GROUP BY doc_id"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '({substring_dedup.CUT})', '\\1' || chr(57344), 'g'), chr(57344)) ps FROM documents),
p AS (SELECT doc_id, i, ps[i] p, list_filter(regexp_split_to_array(translate(ps[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_S}), lambda x: x <> '') ws
  FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) i FROM d)),
g AS (SELECT doc_id, i, len(ws) n, 0 place FROM p WHERE i = 1
  UNION ALL SELECT doc_id, p.i, CASE WHEN cut THEN w ELSE n + w END, place + CAST(cut AS INTEGER)
  FROM (SELECT g.doc_id, p.i, n, place, len(ws) w, n >= {substring_dedup.MIN_WORDS} OR (n > 0 AND len(ws) >= {substring_dedup.MIN_WORDS}) cut FROM g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1) p),
u AS (SELECT doc_id, place, string_agg(p, '' ORDER BY i) u, flatten(list(ws ORDER BY i)) ws FROM g JOIN p USING (doc_id, i) GROUP BY doc_id, place),
r AS (SELECT doc_id, place, u, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY place) b, len(ws) >= {substring_dedup.MIN_WORDS} AND count(*) OVER w > 1 twice,
  len(ws) >= {substring_dedup.MIN_WORDS} AND row_number() OVER (w ORDER BY doc_id, place) > 1 gone FROM u WINDOW w AS (PARTITION BY array_to_string(ws, ' '))),
k AS (SELECT doc_id, count(*) n_units, count(*) FILTER (WHERE twice) n_repeats, count(*) FILTER (WHERE gone) n_removed,
  coalesce(string_agg(CAST(b - length(u) AS BIGINT) || '-' || CAST(b AS BIGINT), ',' ORDER BY place) FILTER (WHERE gone), '') removed_spans,
  coalesce(string_agg(u, '' ORDER BY place) FILTER (WHERE NOT gone), '') kept FROM r GROUP BY doc_id)
SELECT doc_id, n_units, n_repeats, n_removed, removed_spans, CAST(length(kept) AS BIGINT) n_kept_chars, sha256(kept) kept_sha256 FROM k"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
}
ORACLES = {"op3_license_scan": OP3, "op6_substring_dedup": OP6, "op4_benchmark_decontamination": OP4, "op9_quality_rules": OP9}
