"""The queries of the training-data operators and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import (
    bpe,
    embedding_dedup,
    exact_dedup,
    fill_middle,
    hard_negatives,
    mixing,
    near_dedup,
    quality,
    sharding,
    token_count,
    token_file,
    toxicity,
    url_filter,
)
from rillflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _tokenizer(name: str) -> Callable[[], str]:
    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return path


BYTE_BPE = _tokenizer("byte_bpe_50k.json")
WORD_BPE = _tokenizer("word_bpe_49k.json")
PIECES = _tokenizer("piece_bpe_32k.model")


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = url_filter.outcomes_of(table(spark, sf_dir, "labels"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRENGTH = """(SELECT 1 / least(1.0, greatest(coalesce(CASE WHEN sum(n * m * (1 - m) * (n - 1)) = 0 THEN NULL
  ELSE sum((good - n * m) ** 2 - n * m * (1 - m)) / sum(n * m * (1 - m) * (n - 1)) END, 0), 1 / 1001.0)) - 1 FROM {0})"""
ORACLES["op1_url_filter"] = f"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '(?s)^([^/?#]*)', 1)")} host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) path FROM u),
l AS (SELECT doc_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 WHEN quality IS NULL THEN NULL ELSE 0 END good FROM labels),
h0 AS (SELECT host, count(good)::DOUBLE n, coalesce(sum(good), 0)::DOUBLE good, string_split(host, '.') parts
  FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
h AS (SELECT host, n, good, array_to_string(parts[-k:], '.') suffix, array_to_string(parts[-k-1:], '.') domain
  FROM (SELECT *, CASE WHEN len(parts) >= 2 AND array_to_string(parts[-2:], '.') IN
    ('co.uk','org.uk','ac.uk','com.au','co.jp','com.br','co.nz','co.in','com.cn') THEN 2 ELSE 1 END k FROM h0)),
d AS (SELECT suffix, domain, sum(n) n, sum(good) good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) n, sum(good) good FROM d GROUP BY ALL),
r AS (SELECT (sum(good) + 1) / (sum(n) + 2) m FROM s),
s1 AS (SELECT suffix, n, good, m FROM s, r),
s2 AS (SELECT suffix, (good + m * k) / greatest(n + k, 1e-9) mean FROM s1, (SELECT {_STRENGTH.format("s1")} k)),
d1 AS (SELECT domain, n, good, s2.mean m FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT domain, (good + m * k) / greatest(n + k, 1e-9) mean FROM d1, (SELECT {_STRENGTH.format("d1")} k)),
h1 AS (SELECT host, n, good, d2.mean m FROM h JOIN d2 USING (domain)),
h2 AS (SELECT host, (good + m * k) / greatest(n + k, 1e-9) mean, n + k weight FROM h1, (SELECT {_STRENGTH.format("h1")} k)),
rules(rule, rule_host, rule_path, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
f AS (SELECT page_id, host, path, max_by(struct_pack(rule := rule, verdict := verdict), len(rule)) fit FROM p JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.fit.rule AS rule,
  coalesce(f.fit.verdict, CASE WHEN mean + 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) < 0.6 THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN h2 USING (host) LEFT JOIN f ON f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host AND f.path = p.path"""


@_query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLES["op2_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT size,
  (('0x' || substr(md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5)
    / 4503599627370496.0 u FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE weight,
  3 * source_size most, sum(source_size) OVER ()::BIGINT total FROM s),
f AS (SELECT *, most / weight full_at FROM w),
v AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM f),
t AS (SELECT source, source_size, CASE WHEN lev IS NULL OR full_at <= lev THEN most::DOUBLE ELSE lev * weight END target
  FROM (SELECT *, max(level) FILTER (level < full_at) OVER () lev FROM v)),
p AS (SELECT *, floor(ratio) whole, ratio - floor(ratio) fraction, round(target - floor(ratio) * source_size)::BIGINT gap
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END ratio FROM t)),
k AS (SELECT d.doc_id, d.size, d.u, p.*, CASE WHEN gap > 0 AND size > 0 AND fraction > 0
  THEN (u / (1 - u)) / (fraction / (1 - fraction) * sqrt(size::DOUBLE)) END rank FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
o AS (SELECT *, sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY
  floor(rank / (1 + rank) * 1099511627776.0) NULLS LAST, u, size, doc_id ROWS UNBOUNDED PRECEDING) run FROM k)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN rank IS NOT NULL AND 2 * (run - gap) <= size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM o"""


@_query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op3_near_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i+4] END, ' ') sh
  FROM w, unnest(range(1, greatest(2, len(ws) - 3))) r(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
c AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
x AS (SELECT doc_id, hash(sh) sh FROM s SEMI JOIN c USING (sh)),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id a, y.doc_id b, count(*) common FROM x JOIN x y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT r.a, l.b FROM r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a doc_id, min(b) component_id FROM r GROUP BY a) m USING (doc_id)"""


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.col("_rule").getField(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return out.select("doc_id", *counts, F.col("_rule_kept").alias("kept"))


def _half(p: str, q: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) ELSE 0 END"
    return f"0.5 * ({part(p)} + {part(q)})"


_LISTED = ", ".join(f"('{lang}', '{w}', {q!r}::DOUBLE)" for lang, ws in quality.FUNCTION_WORDS.items() for w, q in quality.prior_shares(ws).items())
_CLASSES = dict(zip(("space", "digit", "symbol", "wide", "rest"), quality.PRIOR_CLASSES))
_K = quality.PRIOR_WORDS
_KB = _K * quality.PRIOR_WORD_BYTES
ORACLES["op4_quality_rules"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id, lang, coalesce(text, '') t,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
win AS (SELECT rid, i, ws[i:i+7] w FROM d, unnest(range(1, len(ws) - 6)) r(i) WHERE len(ws) >= 8),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
rep AS (SELECT rid, sum(g) r FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) g FROM dup) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) dl FROM (SELECT rid, unnest(string_split(t, chr(10))) l FROM d)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
b AS MATERIALIZED (SELECT rid, doc_id, lang, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars,
  (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT n_symbols, coalesce(dl, 0)::BIGINT n_dup_lines, coalesce(r, 0)::BIGINT n_repeat_words,
  length(t) - length(array_to_string(ws, '')) "space", length(t) - length(translate(t, '{quality.DIGITS}', '')) digit, strlen(t) - length(t) wide, strlen(t) n_bytes
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
p AS MATERIALIZED (SELECT *, n_symbols symbol, n_bytes - "space" - digit - n_symbols - wide rest,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM b),
fw(lang, w, prior) AS (VALUES {_LISTED}),
c AS MATERIALIZED (SELECT rid, w, count(*) k FROM (SELECT rid, unnest(ws) w FROM d) WHERE w IN (SELECT w FROM fw) GROUP BY ALL),
tot AS (SELECT l.lang, coalesce(sum(n_words), 0) total,
  {", ".join(f'({_KB} * {q} + coalesce(sum("{x}"), 0)::DOUBLE) / ({_KB} + coalesce(sum(n_bytes), 0)) q_{x}' for x, q in _CLASSES.items())}
  FROM (SELECT DISTINCT lang FROM fw) l LEFT JOIN p USING (lang) GROUP BY l.lang),
rw AS MATERIALIZED (SELECT fw.lang, fw.w, ({_K} * prior + coalesce(k, 0)) / ({_K} + total) q FROM fw JOIN tot USING (lang)
  LEFT JOIN (SELECT lang, w, sum(k) k FROM c JOIN p USING (rid) GROUP BY ALL) u ON u.lang = fw.lang AND u.w = fw.w),
ref AS MATERIALIZED (SELECT * FROM tot JOIN (SELECT lang, sum(q) held FROM rw GROUP BY lang) USING (lang)),
m AS (SELECT c.rid, rw.lang, sum({_half("(k / n_words::DOUBLE)", "q")} - 0.5 * q) dd, sum(k) kk FROM c JOIN p USING (rid) JOIN rw USING (w) GROUP BY ALL),
x AS (SELECT p.rid, n_words, n_bytes,
  sqrt(greatest(0, {" + ".join(_half(f'("{x}"::DOUBLE / n_bytes)', f"q_{x}") for x in _CLASSES)})) cd,
  sqrt(greatest(0, 0.5 * held + coalesce(dd, 0) + {_half("((n_words - coalesce(kk, 0)) / n_words::DOUBLE)", "(1 - held)")}))
    / sqrt(0.5 * held + {_half("1.0", "(1 - held)")}) wd
  FROM p JOIN ref ON NOT base_failed LEFT JOIN m ON m.rid = p.rid AND m.lang = ref.lang),
v AS (SELECT rid, (any_value(n_bytes) < {quality.MIN_BYTES} OR min(cd) <= {quality.MOST_CLASS_DISTANCE})
  AND (any_value(n_words) < {quality.MIN_WORDS} OR min(wd) <= {quality.MOST_WORD_SHARE}) ok FROM x GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(ok, true) AS kept FROM p LEFT JOIN v USING (rid)"""


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), PIECES())


@_query
def op6_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = sharding.read_shards(spark, sharding.write_shards(docs), docs)
    return out.select(
        "record.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_file.write_token_files(table(spark, sf_dir, "documents"), WORD_BPE())
    back = token_file.read_token_files(spark, manifest)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def coded_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_digests(bpe.encode_and_decode(table(spark, sf_dir, "documents"), BYTE_BPE()))


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.grace_dedup(table(spark, sf_dir, "documents"))[0]


ORACLES["op10_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


@_query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    hashed = lambda text: F.sha2(text.cast("binary"), 256)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select(
        "record.doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(back).alias("restored_sha256")
    )


ORACLES["op12_fill_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) s,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u FROM documents),
h AS (SELECT *, len(u) n, ('0x' || substr(s, 1, 8))::BIGINT h1, ('0x' || substr(s, 9, 8))::BIGINT h2, ('0x' || substr(s, 17, 8))::BIGINT h3,
  ('0x' || substr(s, 25, 8))::BIGINT h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END form FROM h),
x AS (SELECT *, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') r FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || r || '<M>' || m WHEN 'spm' THEN '<S>' || r || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM x"""


@_query
def op13_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op13_embedding_duplicates"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () r, vec_id, embedding::DOUBLE[] v,
  embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ok FROM embeddings),
l AS MATERIALIZED (SELECT a.r a, b.r b, b.vec_id id FROM v a JOIN v b ON a.ok AND b.ok AND len(a.v) = len(b.v) AND a.r <> b.r
  AND list_cosine_similarity(a.v, b.v) >= 0.95),
c AS (SELECT r a, r b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT c.a r, min(v.vec_id) component_id FROM c JOIN v ON c.b = v.r GROUP BY c.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.r)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m USING (r)"""


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLES["op11_hard_negatives"] = """
WITH v AS (SELECT row_number() OVER () r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END y,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r, a.vec_id anchor_id, b.r other, b.vec_id, a.y = b.y same, list_inner_product(a.q, b.q)::BIGINT score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.r = p.r AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 3"""
