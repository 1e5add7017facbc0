"""The queries op1 to op13: each applies its operator to its whole table.

Where an operator's rows can be said in SQL, ORACLES has DuckDB SQL for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import decontaminate, fim, licenses, lines, lm, merkle, mixing, quality, repeats, sharding, simhash, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), shards=40)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_scores(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle_digests(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_kd_sharding": op4_kd_sharding,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_token_counts": op6_token_counts,
    "op7_language_scores": op7_language_scores,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_SHINGLES = r"""list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))"""
_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_NORMAL = r"""regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')"""

#: DuckDB SQL. The others have none: SimHash, k-d trees, Bloom filters, alignments and tokenizers are not SQL.
ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": f"""
WITH i AS (SELECT item_id, list_sort({_SHINGLES}) AS s FROM (SELECT item_id, {_NORMAL} AS ws FROM benchmark)),
items AS (SELECT min(item_id) AS item_id, s FROM i WHERE len(s) > 0 GROUP BY s),
parts AS (SELECT item_id, len(s) AS n, unnest(s) AS x FROM items),
d AS (SELECT doc_id, unnest({_SHINGLES}) AS x FROM (SELECT doc_id, {_NORMAL} AS ws FROM documents)),
found AS (SELECT doc_id, item_id, n, count(*) AS shared FROM d JOIN parts USING (x) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, shared AS n_shared, shared / n AS containment FROM found WHERE shared >= 0.8 * n - 1e-9""",
    "op5_warc_round_trip": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first <> page_id THEN first END AS refers_to, url FROM f""",
    "op8_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_echoes FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 4 * n_letters < word_chars OR 10 * n_echoes > 4 * n_words) AS kept FROM b""",
    "op10_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS tag FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM t),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0.0)) AS level FROM w
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(cap, max(level) FILTER (cap / w >= level) OVER () * w) AS target FROM l),
q AS (SELECT *, CAST(floor(target) AS BIGINT) AS quota, ceil((SELECT sum(floor(target)) FROM g) / (16 * 256)) AS words FROM g),
o AS (SELECT doc_id, size, source_size, target, quota, greatest(16, words)::BIGINT AS b, sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || tag || '|7'), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (SELECT *, unnest(range(0, 4)) AS epoch FROM o),
s AS (SELECT *, epoch * source_size + before AS lo, least(epoch * source_size + before + size, quota) AS hi FROM e)
SELECT doc_id, size, source_size, target, CAST(coalesce(sum(hi - lo) FILTER (hi > lo), 0) AS BIGINT) AS taken,
CAST(coalesce(sum((hi - 1) // b - lo // b + 1) FILTER (hi > lo), 0) AS BIGINT) AS n_pieces FROM s GROUP BY doc_id, size, source_size, target, before""",
    "op11_fill_in_middle": r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
d AS (SELECT doc_id, t, n, [('0x' || s[8 * k + 1:8 * k + 8])::BIGINT for k in range(0, 4)] AS d FROM h),
c AS (SELECT doc_id, t, n, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
g AS (SELECT key, min(doc_id) AS first, count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) AS documents FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT r, k.doc_id, pos, line, documents >= 2 AND (k.doc_id > first OR k.doc_id IS NULL AND first IS NOT NULL) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone IS NOT TRUE), '')) AS kept_sha256 FROM m GROUP BY r, doc_id""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {_LEAF.format("n_chars")} AS leaf,
CASE WHEN {_CRC.format("doc_id")} % 7 = 0 THEN {_LEAF.format("n_chars + 1")} ELSE {_LEAF.format("n_chars")} END AS now FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM l),
t AS (SELECT tree, 0 AS level, place, n, leaf AS node FROM p UNION ALL
SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM t WHERE n > 1 GROUP BY tree, level, place // 2, n),
s AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place, n, subroot AS node FROM s UNION ALL
SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM u WHERE n > 1 GROUP BY level, place // 2, n),
a AS (SELECT tree, level, place, n, node FROM t WHERE n > 1 UNION ALL SELECT NULL, level, place, n, node FROM u),
f AS (SELECT r, p.tree, 0 AS level, p.place, p.n, now AS node, '' AS proof, false AS over FROM p UNION ALL
SELECT f.r, f.tree, CASE WHEN f.n > 1 THEN f.level + 1 ELSE 0 END, CASE WHEN f.n > 1 THEN f.place // 2 ELSE s.place END, CASE WHEN f.n > 1 THEN (f.n + 1) // 2 ELSE s.n END,
CASE WHEN f.n > 1 THEN sha256(CASE WHEN f.place % 2 = 1 THEN b.node || f.node ELSE f.node || coalesce(b.node, '') END) ELSE f.node END, f.proof || coalesce(b.node, ''), f.over OR f.n = 1
FROM f JOIN s ON s.tree = f.tree LEFT JOIN a AS b ON f.n > 1 AND b.level = f.level AND b.place = xor(f.place, 1) AND CASE WHEN f.over THEN b.tree IS NULL ELSE b.tree = f.tree END
WHERE NOT (f.over AND f.n = 1)),
e AS (SELECT r, node, proof FROM f WHERE over AND n = 1)
SELECT doc_id, leaf, subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, e.node AS folded_root, e.node = (SELECT node FROM u WHERE n = 1) AS verified FROM p JOIN s USING (tree) JOIN e USING (r)""",
}
