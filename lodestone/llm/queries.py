"""The queries over the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, jaccard, line_dedup, lm_score, mixing, pii, quality, sharding, suffix_dedup, token_counts, toxicity, vector_codes

SHARDS = 40
#: Where the machines keep the ranks of the tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute(_read(spark, sf_dir, "documents"), TOKENIZER, ["doc_id"])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(_read(spark, sf_dir, "documents"))
    return found.select(F.col("k").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"), keep=lambda d: F.struct(d["doc_id"]))
    base = F.concat(*(F.col(k.name) for k in pii.KINDS if k.base))
    spans = F.concat(*(F.col(k.name) for k in pii.KINDS))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in pii.KINDS if k.base),
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
        *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in pii.KINDS if not k.base),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    weights, bias = toxicity.train(docs, labels.filter(~_fold(0)))
    scored = toxicity.score(docs, weights, bias, ["doc_id"])
    return scored.select("doc_id", _fold(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _fold(remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == remainder


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(_read(spark, sf_dir, "documents"))


def sharded(docs: DataFrame) -> DataFrame:
    out = sharding.assign(docs, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents"), keep_rows=False)
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("row.doc_id", "row.source", "row.text", "copy", "mix")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), ["doc_id"])


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents")).select("row.doc_id", "class_id", "n_links", "n_class_links")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(_read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_line_dedup": op11_line_dedup,
    "op12_divergence": op12_divergence,
    "op13_vector_codes": op13_vector_codes,
}

#: Host rules over words, lines and windows; rates by moments as in quality.
QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '(none)') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM t),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS g FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT host, rule, count(*) AS n, count(*) FILTER (WHERE CASE rule WHEN 'short' THEN n_words < 10 WHEN 'repeats' THEN 100 * n_repeat_words > 20 * n_words WHEN 'symbols' THEN 10 * n_symbols > n_words
  WHEN 'lines' THEN 10 * n_dup_lines > 3 * n_lines ELSE word_chars < 2 * n_words OR word_chars > 15 * n_words END) AS f FROM m, (SELECT unnest(['short', 'repeats', 'symbols', 'lines', 'lengths']) AS rule) GROUP BY host, rule),
p AS (SELECT rule, sum(n) AS n, sum(f) AS f, sum(CAST(f AS DOUBLE) * f / n) AS q, count(*) AS h FROM f GROUP BY rule),
v AS (SELECT rule, (f + 0.5) / (n + 1) AS mean, q / n - (f / n) * (f / n) - (h - 1) * (f / n) * (1 - f / n) / n AS between_hosts FROM p),
s AS (SELECT rule, mean, CASE WHEN between_hosts <= 0 THEN 10000.0 ELSE least(10000.0, greatest(2.0, mean * (1 - mean) / between_hosts - 1)) END AS strength FROM v),
r AS (SELECT host, max((f + mean * strength) / (n + strength)) > 0.5 AS rejected FROM f JOIN s ON f.rule = s.rule GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT rejected AS kept FROM m JOIN r ON m.host = r.host
"""

#: Shingle sets, exact similarities, and components by reachability.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tok AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g5 AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS g FROM tok WHERE n >= 5 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT DISTINCT doc_id, g FROM g5 WHERE g IS NOT NULL UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM c JOIN k x ON a = x.doc_id JOIN k y ON b = y.doc_id WHERE 10 * c >= 8 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
cls AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
own AS (SELECT doc_id, least(doc_id, coalesce(min(b) FILTER (WHERE same), doc_id)) AS rep FROM documents LEFT JOIN l ON doc_id = a GROUP BY doc_id),
n AS (SELECT l.a, count(*) AS n_links, count(DISTINCT own.rep) FILTER (WHERE NOT same) AS n_class_links FROM l JOIN own ON l.b = own.doc_id GROUP BY l.a)
SELECT cls.a AS doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_class_links, 0) AS n_class_links FROM cls LEFT JOIN n ON cls.a = n.a
"""

#: All strings of 100 bytes, as hexadecimal digits; runs of those that occurred before; what is left between the runs.
SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(CAST(length(h) / 2 AS BIGINT) - 99, 0))) AS s FROM d)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM x) WHERE k > 1),
mark AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM again),
num AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS r FROM mark),
run AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM num GROUP BY doc_id, r),
gap AS (SELECT run.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS piece FROM run JOIN d ON run.doc_id = d.doc_id WINDOW w AS (PARTITION BY run.doc_id ORDER BY a)),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS head FROM gap GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id
"""

#: Bags of shingles of all item-sized windows that share a shingle with an item; items have five words or more.
LEAKS_SQL = r"""
WITH distinct_item AS (SELECT min(item_id) AS id, count(*) AS n_items, any_value(text) AS text FROM benchmark
  GROUP BY regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')),
low AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', id, text FROM distinct_item),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM low),
tok AS (SELECT kind, id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM w),
g0 AS (SELECT kind, id, p, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS g FROM tok WINDOW d AS (PARTITION BY kind, id ORDER BY p)),
g AS (SELECT * FROM g0 WHERE g IS NOT NULL),
size AS (SELECT kind, id, count(*) AS m FROM g GROUP BY kind, id),
item AS (SELECT id, g, count(*) AS c FROM g WHERE kind = 'i' GROUP BY id, g),
hit AS (SELECT g.id AS doc_id, item.id AS item_id, g.g, g.p, item.c, si.m, sd.m AS n FROM g JOIN item ON g.g = item.g JOIN size si ON si.kind = 'i' AND si.id = item.id JOIN size sd ON sd.kind = 'd' AND sd.id = g.id WHERE g.kind = 'd'),
st AS (SELECT *, unnest(range(greatest(0, p - m + 1), least(p, greatest(n - m, 0)) + 1)) AS s FROM hit),
part AS (SELECT doc_id, item_id, s, g, least(count(*), any_value(c)) AS x, any_value(m) AS m, any_value(n) AS n FROM st GROUP BY doc_id, item_id, s, g),
win AS (SELECT doc_id, item_id, s, CAST(sum(x) AS DOUBLE) AS x, any_value(m) AS m, least(any_value(m), any_value(n)) AS held FROM part GROUP BY doc_id, item_id, s),
sim AS (SELECT doc_id, item_id, s, x / (held + m - x) AS similarity, held FROM win)
SELECT doc_id, item_id, n_items, similarity, CAST(s AS BIGINT) AS first_word, CAST(held + 4 AS BIGINT) AS n_words FROM
  (SELECT sim.*, n_items, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS k FROM sim JOIN distinct_item ON item_id = distinct_item.id WHERE similarity >= 0.8 - 1e-12) WHERE k = 1
"""

#: The checksum of a text's bytes, by a table that follows from its polynomial.
CRC = """crc_table AS (SELECT list(c ORDER BY i) AS l FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], [CAST(0 AS BIGINT) for z in range(8)]),
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)))"""


def _crc(text: str) -> str:
    """SQL for the checksum of a column, beside crc_table."""
    step = "lambda c, b: xor(c >> 8, crc_table.l[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))), {step}), 4294967295)"


def _uniform(text: str) -> str:
    """SQL for common.uniform of a text."""
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


def _won(name: str, shards: int) -> str:
    """SQL for a table name (doc_id, size, text_crc32, n, k, shard): the shard of the least draw. A node draws what the least of its shards does."""
    u = _uniform("k || ':shard:' || i")
    return f"""{name} AS (SELECT doc_id, size, text_crc32, n, k, CAST(arg_min(i, {{'d': -ln({u}), 'n': i}}) AS INTEGER) AS shard
  FROM rows_, (SELECT unnest(range({shards})) AS i) GROUP BY doc_id, size, text_crc32, n, k)"""


#: The least draw of all shards, and with one more; slots by bucket, id, checksum and size, copies of a row one after another.
SHARDS_SQL = f"""
WITH {CRC},
d AS (SELECT doc_id, CAST(octet_length(encode(t)) + 16 AS BIGINT) AS size, {_crc("t")} AS text_crc32 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), crc_table),
rows_ AS (SELECT *, coalesce('=' || doc_id, 'null') AS k FROM (SELECT doc_id, size, text_crc32, count(*) AS n FROM d GROUP BY doc_id, size, text_crc32)),
{_won("now", SHARDS)}, {_won("grown", SHARDS + 1)}, s AS (SELECT a.*, b.shard AS grown_shard,
  floor({_uniform("a.k || ':' || a.text_crc32 || ':' || a.size || ':slot'")} * (1 + (SELECT count(*) FROM rows_) // {SHARDS * sharding.SLOT_ROWS})) AS bucket
  FROM now a JOIN grown b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.size = b.size AND a.text_crc32 = b.text_crc32)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard
FROM (SELECT *, unnest(range(n)) FROM s)
"""

#: Rates by source; the distribution function of each, step by step; copies by the steps that lie below the draw. Ids are not repeated.
MIXING_SQL = f"""
WITH RECURSIVE m AS (SELECT coalesce('=' || source, 'null') AS place, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS mass FROM documents GROUP BY 1),
share AS (SELECT place, mass, CASE WHEN mass > 0 THEN pow(CAST(mass AS DOUBLE), 0.5) ELSE 0.0 END AS share FROM m),
rate AS (SELECT place, CASE WHEN mass > 0 THEN CAST((SELECT sum(mass) FROM share) AS DOUBLE) * share / (SELECT sum(share) FROM share) / mass ELSE 0.0 END AS rate FROM share),
part AS (SELECT place, rate, greatest(CAST(ceil(rate / {mixing.PART_MEAN}) AS INTEGER), 1) AS parts FROM rate WHERE rate > 0),
cdf AS (SELECT place, rate / parts AS mean, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM part
  UNION ALL SELECT place, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
draw AS (SELECT doc_id, source, text, place, '=' || doc_id AS id, unnest(range(1, parts + 1)) AS i FROM documents JOIN part ON part.place = coalesce('=' || source, 'null')),
n AS (SELECT draw.doc_id, draw.source, draw.text, draw.id, CAST(count(cdf.k) AS BIGINT) AS n FROM draw LEFT JOIN cdf ON cdf.place = draw.place AND cdf.c < {_uniform("id || ':17:' || i")} GROUP BY ALL)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, CAST('0x' || substr(md5(id || ':17:mix:' || copy), 1, 15) AS BIGINT) AS mix FROM (SELECT *, unnest(range(n)) AS copy FROM n)
"""

#: Lines with their keys; documents and keeper of each key; what is left of each text. Ids are not repeated.
LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM x),
bad AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR doc_id >= keeper), '')) AS kept_sha256
FROM k LEFT JOIN bad ON k.k = bad.k GROUP BY doc_id
"""

#: Matches by group, the vocabulary of each language, whole-number shares of every group and term, distances and ranks.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
m AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS lang_count FROM m GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
vs AS (SELECT lang, count(*) AS v, CAST(sum(lang_count) AS HUGEINT) AS lang_total FROM v GROUP BY lang),
c AS (SELECT m.lang, source, m.term, count(*) AS c FROM m JOIN v ON m.lang = v.lang AND m.term = v.term GROUP BY m.lang, source, m.term),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5) // (coalesce(n.total, 0) + 5 * vs.v) AS p,
  1 + CAST(1000000000 AS HUGEINT) * (v.lang_count + 5) // (vs.lang_total + 5 * vs.v) AS q FROM g JOIN vs ON g.lang = vs.lang JOIN v ON g.lang = v.lang
  LEFT JOIN n ON g.lang = n.lang AND g.source = n.source LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND v.term = c.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

_NEAREST = """a{r} AS MATERIALIZED (SELECT vec_id, p.part, arg_min(b.e, {{'d': {d}, 'e': b.e}}) AS e, min({d}) AS d FROM p JOIN b{r} b ON p.part = b.part GROUP BY vec_id, p.part)"""
_DISTANCE = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_CENTRE = """s{r} AS (SELECT a.part, a.e, j, CAST(sum(p.v[j]) AS BIGINT) AS s, count(*) AS c FROM a{r} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part, (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS j) GROUP BY a.part, a.e, j),
b{n} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT part, e, list((s - ((s % c) + c) % c) // c ORDER BY j) AS v FROM s{r} GROUP BY part, e) n ON b.part = n.part AND b.e = n.e)"""

#: Parts of each vector as whole numbers; rounds of nearest entries and their means, unrolled. Ids are not repeated, and vectors have one length.
CODES_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS v FROM k, (SELECT unnest(range(8)) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16)),
{", ".join(_NEAREST.format(r=r, d=_DISTANCE) + ", " + _CENTRE.format(r=r, n=r + 1) for r in range(vector_codes.ROUNDS))},
{_NEAREST.format(r=vector_codes.ROUNDS, d=_DISTANCE)},
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{vector_codes.ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{vector_codes.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h
"""

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": SUFFIX_SQL,
    "op6_sharding": SHARDS_SQL,
    "op7_quality": QUALITY_SQL,
    "op8_mixing": MIXING_SQL,
    "op9_decontamination": LEAKS_SQL,
    "op10_jaccard_join": JACCARD_SQL,
    "op11_line_dedup": LINES_SQL,
    "op12_divergence": DIVERGENCE_SQL,
    "op13_vector_codes": CODES_SQL,
}
