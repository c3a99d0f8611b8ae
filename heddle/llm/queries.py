"""The registered queries opN_<name> and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bpe, chat, clusters, decontaminate, divergence, html_text, lm, mixing, quality, simhash, substrings, suffixes, warc
from heddle.llm.shared import stored, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "epoch", F.round("position", 6).alias("position"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})  # sums of logarithms, in whatever order


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = stored(quality.features(docs).drop("text"), "quality")
    judged = quality.quality_rules(found, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.ball_kmeans(table(spark, sf_dir, "embeddings"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH norm AS (SELECT doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM norm),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') AS g
  FROM iw, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
dwin AS (SELECT id, s, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS g FROM dw, sizes, unnest(range(1, len(w) - m + 2)) AS u(s) WHERE len(w) >= m),
hit AS (SELECT DISTINCT id, s, m, item FROM dwin JOIN win USING (m, g)),
pos AS (SELECT id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + m)) AS u(p) GROUP BY id),
its AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (id) LEFT JOIN its USING (id)
"""

OP1_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT *, sha1(h) AS sha, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
e AS (SELECT *, list_transform(range(0, 32), lambda k: CAST(('0x' || substr(sha || '00', 1 + CAST(floor(5 * k / 4) AS BIGINT), 3)) AS BIGINT)) AS digits FROM d)
SELECT page_id, url, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((digits[k + 1] >> (12 - 5 - (5 * k) % 4)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM e
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT id, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS u(s) WHERE len(w) >= 35),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT id, p FROM x JOIN r USING (h), unnest(range(s, s + 35)) AS u(p)),
gl AS (SELECT id, list(p) AS gone, count(*) AS n FROM g GROUP BY id),
k AS (SELECT d.id, string_agg(w[i], ' ' ORDER BY i) AS kept FROM d, unnest(range(1, len(w) + 1)) AS u(i) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = d.id AND g.p = i) GROUP BY d.id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gl USING (id) LEFT JOIN k USING (id)
"""

OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(md5(role) || md5(text) ORDER BY turn, role, text) AS turns,
  string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>', chr(10) ORDER BY turn, role, text) AS rendered FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT array_to_string(list_slice(turns, 1, k), '/') AS prefix FROM c, unnest(range(1, len(turns))) AS u(k)),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, array_to_string(turns, '/') AS whole FROM c GROUP BY array_to_string(turns, '/'))
SELECT w.conv_id, c.rendered, CAST(len(c.turns) AS BIGINT) AS n_turns, w.n_copies
FROM w JOIN c USING (conv_id) WHERE w.whole NOT IN (SELECT prefix FROM p)
"""

OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens) AS tokens FROM d GROUP BY source),
tot AS (SELECT CAST(sum(tokens) AS DOUBLE) AS budget FROM s),
g(i) AS (SELECT unnest(range(0, 33))),
r(k, low, width) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT k + 1, CASE WHEN least_i IS NULL THEN low + width - width / 32 WHEN least_i = 0 THEN low - width / 32 ELSE low + (least_i - 1) * (width / 32) END, width / 32
  FROM (SELECT k, low, width, (
      SELECT min(i) FROM (SELECT i, max(pow(tokens, r.low + i * (r.width / 32)) / tokens) / sum(pow(tokens, r.low + i * (r.width / 32))) * any_value(budget) AS epochs FROM g, s, tot WHERE tokens > 0 GROUP BY i)
      WHERE epochs <= 4) AS least_i FROM r WHERE k < 4)),
a AS (SELECT CASE WHEN low < 0 THEN 0 ELSE low + width END AS a FROM r WHERE k = 4),
z AS (SELECT sum(pow(CAST(tokens AS DOUBLE), a)) AS z FROM s, a WHERE tokens > 0),
w AS (SELECT source, CAST(tokens AS BIGINT) AS tokens, CAST(floor(pow(CAST(tokens AS DOUBLE), a) / z * budget) AS BIGINT) AS want FROM s, a, z, tot WHERE tokens > 0),
x AS (SELECT d.*, tokens, want, greatest(1, CAST(ceil(tokens / 1048576.0) AS BIGINT)) AS blocks, unnest(range(0, CAST(ceil(want / CAST(tokens AS DOUBLE)) AS BIGINT))) AS epoch
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source WHERE n_tokens > 0 AND want > 0),
y AS (SELECT *, CAST(('0x' || substr(md5('17/block/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || n_tokens), 1, 12)) AS BIGINT) % blocks AS block,
  md5('17/' || epoch || '/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || n_tokens) AS ord FROM x),
b AS (SELECT source, epoch, block, sum(n_tokens) AS total FROM y GROUP BY source, epoch, block),
bb AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY source, epoch ORDER BY md5('17/' || epoch || '/' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
v AS (SELECT y.*, before, coalesce(sum(n_tokens) OVER (PARTITION BY y.source, y.epoch, y.block ORDER BY ord, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside
  FROM y JOIN bb ON y.source IS NOT DISTINCT FROM bb.source AND y.epoch = bb.epoch AND y.block = bb.block)
SELECT doc_id, source, n_tokens, epoch, round((epoch * tokens + before + inside) / CAST(want AS DOUBLE), 6) AS position
FROM v WHERE epoch * tokens + before + inside < want
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
x AS (SELECT rid, doc_id, octet_length(b) AS n, hex(b) AS h FROM d),
w AS (SELECT rid, doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS g FROM x, unnest(range(0, n - 99)) AS u(s) WHERE n >= 100),
first AS (SELECT g, min((coalesce(doc_id, -9223372036854775808), s)) AS f FROM w GROUP BY g HAVING count(*) > 1),
dup AS (SELECT rid, s FROM w JOIN first USING (g) WHERE (coalesce(doc_id, -9223372036854775808), s) <> f),
mark AS (SELECT rid, s, CASE WHEN s - 100 <= lag(s) OVER (PARTITION BY rid ORDER BY s) THEN 0 ELSE 1 END AS new FROM dup),
run AS (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS k FROM mark),
gone AS (SELECT rid, k, min(s) AS a, max(s) + 100 AS z FROM run GROUP BY rid, k),
cut AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY k), 0) AS lo, a AS hi FROM gone UNION ALL SELECT rid, max(z), NULL FROM gone GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, n) - lo)), '' ORDER BY lo) AS k FROM cut JOIN x USING (rid) GROUP BY rid),
tot AS (SELECT rid, count(*) AS spans, sum(z - a) AS removed FROM gone GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(from_hex(coalesce(k, h))) AS kept_sha256
FROM x LEFT JOIN tot USING (rid) LEFT JOIN kept USING (rid)
"""

_RULES = ", ".join(f"('{rule}', {i}, CAST({cut} AS DOUBLE))" for rule, cuts in quality.RULES.items() for i, cut in enumerate(cuts))
_VALUE = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {rule}" for rule in quality.RULES) + " END"

OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
rep AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
ins AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM win JOIN rep USING (rid, g)) GROUP BY rid),
f AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN ins USING (rid)),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_ratio, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0.0 END AS upper_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_ratio FROM f),
c AS (SELECT * FROM (VALUES {_RULES}) AS v(rule, i, cut)),
lab AS (SELECT * FROM r WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
k AS (SELECT lang, rule, i, cut, count(*) AS n, count(*) FILTER (WHERE {_VALUE} > cut) AS k FROM lab, c GROUP BY lang, rule, i, cut),
t AS (SELECT *, CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.01) + (n - j) * ln(0.99)))) END
  <= 0.05 / ({len(quality.RULES)} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM lab))) AS ok FROM k),
first AS (SELECT lang, rule, min(i) FILTER (WHERE NOT ok) AS bad, max(i) AS last FROM t GROUP BY lang, rule),
cuts AS (SELECT t.lang, t.rule, t.cut FROM t JOIN first ON t.lang IS NOT DISTINCT FROM first.lang AND t.rule = first.rule AND t.i = coalesce(bad - 1, last))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.lang IS NOT DISTINCT FROM r.lang AND {_VALUE} > cut) AS kept FROM r
"""

OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [chr(10)]) AS w FROM documents),
h AS (SELECT *, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda crc, x: list_reduce(list_concat([xor(crc, x)], list_transform(range(0, 8), lambda i: CAST(0 AS BIGINT))), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) % 7 = 2 AS held_out FROM d),
t AS (SELECT rid, held_out, i, w[i] AS w, CASE WHEN i = 1 THEN chr(9) ELSE w[i - 1] END AS v, CASE WHEN i = 2 THEN chr(9) WHEN i > 2 THEN w[i - 2] END AS u FROM h, unnest(range(1, len(w) + 1)) AS x(i)),
c1 AS (SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM t WHERE NOT held_out AND u IS NOT NULL GROUP BY u, v, w),
h1 AS (SELECT w AS v, n FROM c1 WHERE w <> chr(10) UNION ALL SELECT chr(9), count(*) FROM h WHERE NOT held_out),
tot AS (SELECT coalesce(sum(n), 0) AS n, count(*) AS v FROM c1),
p AS (SELECT rid, t.i, t.u, coalesce(c1.n, 0) AS n1, (coalesce(c1.n, 0) + 1) / (tot.n + tot.v + 1) AS p1, coalesce(c2.n, 0) AS n2, coalesce(h1.n, 0) AS d2, coalesce(c3.n, 0) AS n3, coalesce(b.n, 0) AS d3
  FROM t CROSS JOIN tot LEFT JOIN c1 ON c1.w = t.w LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN h1 ON h1.v = t.v LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v AND c3.w = t.w LEFT JOIN c2 b ON b.v = t.u AND b.w = t.v),
q AS (SELECT *, (n2 + {lm.KAPPA[0]} * p1) / (d2 + {lm.KAPPA[0]}) AS p2 FROM p),
s AS (SELECT rid, count(*) AS n_tokens, count(*) FILTER (WHERE n1 > 0) AS n_known, fsum(log10(p1)) AS base, fsum(log10(CASE WHEN u IS NULL THEN p2 ELSE (n3 + {lm.KAPPA[1]} * p2) / (d3 + {lm.KAPPA[1]}) END)) AS score FROM q GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, CAST((SELECT n FROM tot) AS BIGINT) AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score FROM h JOIN s USING (rid)
"""


OP11_SQL = rf"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {clusters.DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {clusters.DIMS}),
seed AS (SELECT list(x ORDER BY h) AS c FROM (SELECT x, sha256('{clusters.SEED}:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h LIMIT {clusters.K})),
r(k, c) AS (
  SELECT 0, c FROM seed
  UNION ALL
  SELECT k + 1, list(coalesce(fresh, c[j]) ORDER BY j) FROM (SELECT k, c, unnest(range(1, len(c) + 1)) AS j FROM r WHERE k < {clusters.ROUNDS}) old LEFT JOIN (
    SELECT own, list(m ORDER BY dim) AS fresh FROM (SELECT own, dim, CAST(sum(x[dim]) // count(*) - CASE WHEN sum(x[dim]) < 0 AND sum(x[dim]) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS m FROM (
      SELECT x, arg_min(j, (d, j)) AS own FROM (SELECT v.rid, v.x, j, list_sum(list_transform(list_zip(v.x, r.c[j]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, r, unnest(range(1, {clusters.K} + 1)) AS u(j) WHERE j <= len(r.c)) GROUP BY rid, x), unnest(range(1, {clusters.DIMS} + 1)) AS u(dim) GROUP BY own, dim) GROUP BY own) AS new ON new.own = old.j
  GROUP BY k),
f AS (SELECT c FROM r WHERE k = {clusters.ROUNDS}),
d AS (SELECT rid, vec_id, j, CAST(list_sum(list_transform(list_zip(x, c[j]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, f, unnest(range(1, {clusters.K} + 1)) AS u(j) WHERE j <= len(c)),
a AS (SELECT vec_id, rid, arg_min(j, (d, j)) AS j, min(d) AS distance FROM d GROUP BY vec_id, rid)
SELECT vec_id, CAST(j - 1 AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c[j], ',')) AS centroid_sha256 FROM a, f
"""

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
own AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + (CAST({divergence.UNIT} AS HUGEINT) * (coalesce(n, 0) + {divergence.SMOOTH})) // (total + {divergence.SMOOTH} * v) AS BIGINT) AS p
  FROM own JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + (CAST({divergence.UNIT} AS HUGEINT) * (n + {divergence.SMOOTH})) // (sum(n) OVER (PARTITION BY lang) + {divergence.SMOOTH} * v) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.RANKS}
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_mix_sources": op3_mix_sources,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_text": op5_html_text,
    "op6_simhash": op6_simhash,
    "op7_chat_format": op7_chat_format,
    "op8_lm_score": op8_lm_score,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_bpe": op12_bpe,
    "op13_divergence": op13_divergence,
    "pipeline": pipeline,
}
_ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op2_decontaminate": OP2_SQL, "op3_mix_sources": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op7_chat_format": OP7_SQL, "op8_lm_score": OP8_SQL, "op9_suffix_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL, "op11_ball_kmeans": OP11_SQL, "op13_divergence": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
