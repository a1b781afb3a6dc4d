"""Registered queries over the corpus tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlab.llm import (
    conversation_repair,
    decontaminate,
    embedding_dedup,
    language_id,
    packing,
    periodic_runs,
    quality_fm,
    secret_scan,
    simhash,
    suffix_dedup,
    toxicity_crf,
    training_order,
    url_reputation,
)
from decisionlab.llm.labelled import held_out
from decisionlab.llm.url_reputation import Rule

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# The rules of the page filter.
URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]

URL_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
    ELSE '' END AS rest FROM pages
), rows AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
), counts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
    regexp_extract(host, '[^.]*[.]?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix
  FROM rows LEFT JOIN known
    ON doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(?:[.]html)?/?$', 1), '') AS BIGINT)
  GROUP BY host
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM counts GROUP BY domain, suffix
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), s0 AS (
  SELECT *, greatest(1e-6, least(1 - 1e-6, (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.5 END FROM suffixes))) AS p
  FROM suffixes
), s1 AS (SELECT suffix, (k * p + bad) / (k + n) AS prior FROM s0, (SELECT STRENGTH AS k FROM s0 WHERE n > 0)
), d0 AS (
  SELECT domain, suffix, n, bad, greatest(1e-6, least(1 - 1e-6, prior)) AS p FROM domains JOIN s1 USING (suffix)
), d1 AS (SELECT domain, suffix, (k * p + bad) / (k + n) AS prior FROM d0, (SELECT STRENGTH AS k FROM d0 WHERE n > 0)
), h0 AS (
  SELECT host, n, bad, greatest(1e-6, least(1 - 1e-6, prior)) AS p FROM counts JOIN d1 USING (domain, suffix)
), h1 AS (
  SELECT host, n, bad, k + n AS size, (k * p + bad) / (k + n) AS mean
  FROM h0, (SELECT STRENGTH AS k FROM h0 WHERE n > 0)
), fitting AS (
  SELECT r.page_id, r.host, r.path, rule, verdict,
    row_number() OVER (PARTITION BY r.page_id ORDER BY length(rule) DESC) AS place
  FROM rows r JOIN (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
    ('net/fr/', 'net', '/fr/', 'block')) AS rules (rule, rule_host, rule_path, verdict)
  ON (r.host = rule_host OR ends_with(r.host, '.' || rule_host)) AND starts_with(r.path, rule_path)
)
SELECT r.page_id, r.host, r.path, f.rule,
  coalesce(f.verdict, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  n AS n_labelled, CAST(bad AS BIGINT) AS n_bad
FROM rows r JOIN h1 USING (host) LEFT JOIN fitting f ON f.page_id = r.page_id AND f.place = 1
""".replace("STRENGTH", """1 / least(greatest(CASE WHEN sum(n) > count(*)
      THEN (sum(n * pow(bad / n - p, 2) / (p * (1 - p))) - count(*)) / (sum(n) - count(*))
      ELSE 0.9 END, 0.01), 0.9) - 1""")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the outcome of the document they show: the number that ends their path."""
    labels = read(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.groupBy("doc_id").agg(F.max(F.when(bad, 1).otherwise(0)).alias("bad"))
    number = F.regexp_extract(url_reputation.path_of(F.col("url")), r"/([0-9]{1,18})(?:[.]html)?/?$", 1)
    pages = read(spark, sf_dir, "pages").select("url", number.try_cast("long").alias("doc_id"))
    return pages.join(known, "doc_id").select("url", "bad")


@query(URL_SQL)
def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by the url rules, else by its host's labelled record."""
    pages = read(spark, sf_dir, "pages")
    judged = url_reputation.judge(pages, page_outcomes(spark, sf_dir), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")


# Windows of 13 words with at most two that differ, found by the five positions 0, 1, 3, 6, 7 of a
# seed, which two mismatches can never all hit.
LEAKS_SQL = r"""
WITH lists AS (
  SELECT 'doc' AS side, doc_id AS id, regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10ffff}]+') AS w FROM documents
  UNION ALL
  SELECT 'item', item_id, regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10ffff}]+') FROM benchmark
), texts AS (
  SELECT side, id, list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM lists WHERE len(w) >= 13
), places AS (SELECT side, id, w, unnest(range(1, len(w) - 6)) AS i FROM texts
), seeds AS (
  SELECT side, id, i, concat_ws(' ', w[i], w[i + 1], w[i + 3], w[i + 6], w[i + 7]) AS seed FROM places
), pairs AS (
  SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.i - o AS i, b.i - o AS j
  FROM seeds d JOIN seeds b ON d.side = 'doc' AND b.side = 'item' AND d.seed = b.seed, range(6) AS offsets (o)
)
SELECT DISTINCT doc_id, item_id
FROM pairs JOIN texts d ON d.side = 'doc' AND d.id = doc_id JOIN texts b ON b.side = 'item' AND b.id = item_id
WHERE i >= 1 AND j >= 1 AND i + 12 <= len(d.w) AND j + 12 <= len(b.w)
  AND list_sum(list_transform(range(13), lambda k: CASE WHEN d.w[i + k] = b.w[j + k] THEN 1 ELSE 0 END)) >= 11
"""


@query(LEAKS_SQL)
def op2_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item, but for substituted words."""
    found = decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id")


@query()
def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents' token sequences, written in a keyed order as binary shards."""
    return training_order.materialise(read(spark, sf_dir, "documents"))


@query()
def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 2,048 token ids."""
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False)


SECRETS_SQL = r"""
WITH found AS (
  SELECT doc_id, kind, unnest(m) AS match, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap,
    generate_subscripts(m, 1) AS i
  FROM (
    SELECT doc_id, kind, regexp_extract_all(t, pattern, 0) AS m, string_split_regex(t, pattern) AS g
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), (VALUES
      ('assign', 'ASSIGN'), ('access', 'AKIA[A-Z0-9]{12,}'),
      ('hex', '[0-9a-f]{32,}'), ('random', '[A-Za-z0-9+/_-]{24,}')) AS p (kind, pattern)
  ) WHERE len(m) > 0
), placed AS (
  SELECT doc_id, kind, match, CAST(sum(gap + length(match)) OVER w AS BIGINT) AS stop,
    CAST(sum(gap + length(match)) OVER w AS BIGINT) - length(match) AS start
  FROM found WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING)
), base AS (
  SELECT doc_id, kind, start, stop, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS place
  FROM placed WHERE kind <> 'random' AND (kind <> 'assign' OR length(regexp_extract(match, 'ASSIGN', 2)) >= 8)
), coded AS (
  SELECT *, CASE
      WHEN regexp_full_match(match, '[0-9a-f]+|[0-9A-F]+') AND regexp_matches(match, '[0-9]')
        AND regexp_matches(match, '[A-Fa-f]') THEN 'hex'
      WHEN regexp_full_match(match, '[A-Z2-7]+') AND regexp_matches(match, '[2-7]') AND regexp_matches(match, '[A-Z]') THEN 'base32'
      WHEN regexp_full_match(match, '[0-9a-z]+') AND regexp_matches(match, '[0-9]') AND regexp_matches(match, '[a-z]') THEN 'base36'
      WHEN regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[0-9]') THEN 'base64'
    END AS code
  FROM placed WHERE kind = 'random'
), runs AS (
  SELECT doc_id, start, stop, code || ':' || CAST(CAST(floor(log2(length(match))) AS BIGINT) AS VARCHAR) AS stratum,
    CASE code WHEN 'hex' THEN lower(match) WHEN 'base64' THEN translate(match, '-_', '+/') ELSE match END AS run,
    CASE code WHEN 'hex' THEN '0123456789abcdef' WHEN 'base32' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
      WHEN 'base36' THEN '0123456789abcdefghijklmnopqrstuvwxyz'
      ELSE 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' END AS alphabet
  FROM coded WHERE code IS NOT NULL
), counted AS (
  SELECT *, CAST(length(run) AS DOUBLE) AS n, length(alphabet) AS size,
    list_transform(string_split(run, ''), lambda c: strpos(alphabet, c) - 1) AS v,
    list_sum(list_transform(string_split(alphabet, ''), lambda c: pow(length(run) - length(replace(run, c, '')), 2))) AS squares
  FROM runs
), sided AS (
  SELECT *, list_transform(v, lambda x: CASE WHEN x >= size // 2 THEN 1 ELSE 0 END) AS sides, list_sum(v) / n AS middle FROM counted
), measured AS (
  SELECT *, squares * size / n - n AS chi, CAST(list_sum(sides) AS DOUBLE) AS high,
    1 + list_sum(list_transform(range(1, len(v)), lambda i: CASE WHEN sides[i] <> sides[i + 1] THEN 1 ELSE 0 END)) AS seen,
    list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - middle) * (v[i + 1] - middle))) AS steps,
    list_sum(list_transform(v, lambda x: (x - middle) * (x - middle))) AS variance
  FROM sided
), scaled AS (
  SELECT *, 2 * (n - high) * high / n + 1 AS mean,
    (2 * (n - high) * high / n) * (2 * (n - high) * high / n - 1) / (n - 1) AS spread FROM measured
), scored AS (
  SELECT doc_id, start, stop, stratum, (chi - (size - 1) - n) / sqrt(2 * (size - 1) + 4 * n) AS z1,
    CASE WHEN spread > 0 THEN (abs(seen - mean) - 0.6 * mean) / sqrt(spread) END AS z2,
    CASE WHEN variance > 0 THEN (abs(steps / variance) - 0.6) * sqrt(n) END AS z3 FROM scaled
), levelled AS (
  SELECT doc_id, start, stop, stratum, CAST(ceil(10000 * greatest(
    1 / (1 + exp(-(1.5976 * z1 + 0.07056 * pow(z1, 3)))),
    coalesce(1 / (1 + exp(-(1.5976 * z2 + 0.07056 * pow(z2, 3)))), 1.0),
    coalesce(1 / (1 + exp(-(1.5976 * z3 + 0.07056 * pow(z3, 3)))), 1.0))) AS INTEGER) AS level FROM scored
), cutoffs AS (
  SELECT stratum, max(level) AS cutoff FROM (
    SELECT stratum, level, count(*) OVER (PARTITION BY stratum ORDER BY level) AS place,
      count(*) OVER (PARTITION BY stratum) AS total FROM levelled)
  WHERE level / 10000 <= 0.01 * place / total GROUP BY stratum
), spans AS (
  SELECT doc_id, kind, start, stop, place FROM base
  UNION ALL
  SELECT doc_id, 'random', start, stop, 3 FROM levelled l JOIN cutoffs USING (stratum)
  WHERE level <= cutoff AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = l.doc_id AND b.start < l.stop AND l.start < b.stop)
), lists AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN lists USING (doc_id)
""".replace("ASSIGN", secret_scan.ASSIGN.replace("'", "''"))


@query(SECRETS_SQL)
def op5_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: base patterns, and runs that pass for random."""
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < 3)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select(
        "doc_id", *counts,
        F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


@query()
def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at 4 or fewer differing bits of a 4-word SimHash."""
    groups = simhash.near_groups(read(spark, sf_dir, "documents"), width=4, bits=4)
    return groups.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def scored(found: DataFrame, threshold: float, *more: str) -> DataFrame:
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *more,
    )


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that models may learn from: two thirds of all keys."""
    return read(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))


@query()
def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = read(spark, sf_dir, "documents")
    return scored(quality_fm.score(docs, quality_fm.train(docs, training_labels(spark, sf_dir))), 0.5)


@query()
def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, with the toxic spans."""
    docs = read(spark, sf_dir, "documents")
    found = toxicity_crf.score(docs, toxicity_crf.train(docs, training_labels(spark, sf_dir)))
    return scored(found, 0.7, "spans")


@query()
def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that occur more than once."""
    docs = read(spark, sf_dir, "documents")
    found = suffix_dedup.repeats(docs, length=200).select(
        "mark", "hash",
        F.size("spans").cast("long").alias("n_spans"),
        F.octet_length("kept").cast("long").alias("n_kept"),
        F.sha2("kept", 256).alias("sha256"),
    ).dropDuplicates(["mark", "hash"])
    words = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    whole = docs.select(
        "doc_id", *suffix_dedup.row_marks("doc_id", "text"),
        F.octet_length(words).cast("long").alias("n_bytes"), F.sha2(words, 256).alias("whole"),
    )
    return whole.join(found, ["mark", "hash"], "left").select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.coalesce("n_kept", "n_bytes")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("sha256", "whole").alias("kept_sha256"),
    )


@query()
def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at a cosine of 0.93 or more."""
    links = embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.93)
    return links.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


@query()
def op11_kneser_ney_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from three quarters of their keys."""
    docs = read(spark, sf_dir, "documents")
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = language_id.identify(docs, language_id.train(docs.filter(~apart)))
    return found.select("doc_id", apart.alias("held_out"), F.col("lang").alias("lang_pred"), "score", "accepted")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults in some rows, by the checksum of conversation and turn."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *name).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("fault", fault).filter("fault <> 0")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


# Damage by CRC-32, faults, and the cheapest edits of every state row by row, the least in ASCII order of equals.
REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))
), hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS fault
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, copy,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit JOIN range(2) c(copy) ON copy = 0 OR fault = 3 WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM damaged
), told AS (
  SELECT conv_id, turn, role, text, n, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS kind,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM placed
), counts AS (
  SELECT conv_id, max(n) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id
), inserts (state, more, price, here, lines) AS (VALUES
  (0, '', 0, 0, []::VARCHAR[]), (0, 'I', 3, 2, ['user:']), (0, 'II', 6, 3, ['user:', 'assistant:']),
  (1, '', 0, 1, []), (1, 'I', 3, 2, ['user:']), (1, 'II', 6, 3, ['user:', 'assistant:']),
  (2, '', 0, 2, []), (2, 'I', 3, 3, ['assistant:']), (2, 'II', 6, 2, ['assistant:', 'user:']),
  (3, '', 0, 3, []), (3, 'I', 3, 2, ['user:']), (3, 'II', 6, 3, ['user:', 'assistant:'])
), best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, {'cost': 0, 'edits': '', 'out': []::VARCHAR[]} AS b FROM counts
  UNION ALL
  SELECT conv_id, n, state, min(b) FROM (
    SELECT t.conv_id, t.n, CASE edit WHEN 'D' THEN i.here WHEN 'K' THEN strpos('sua', kind) ELSE CASE i.here WHEN 2 THEN 3 ELSE 2 END END AS state,
      {'cost': b.cost + price + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
          + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
        'edits': b.edits || more || edit,
        'out': list_concat(list_concat(b.out, lines), CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
          ELSE [CASE i.here WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END)} AS b
    FROM best JOIN told t ON t.conv_id IS NOT DISTINCT FROM best.conv_id AND t.n = best.n + 1
      JOIN inserts i ON i.state = best.state, (VALUES ('D'), ('R'), ('K')) e(edit)
    WHERE edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR (kind = 's' AND i.here = 0)
      OR (kind = 'u' AND i.here <> 2) OR (kind = 'a' AND i.here = 2))))
  GROUP BY conv_id, n, state
), ends AS (
  SELECT c.conv_id, min({'cost': b.cost + price, 'edits': b.edits || more, 'out': list_concat(b.out, lines)}) AS b
  FROM best JOIN counts c ON c.conv_id IS NOT DISTINCT FROM best.conv_id AND n = last
    JOIN inserts i ON i.state = best.state AND i.here IN (0, 3)
  GROUP BY c.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost,
  coalesce(b.edits, '') AS audit, sha256(coalesce(array_to_string(b.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query(REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    rows = read(spark, sf_dir, "conversations")
    found = conversation_repair.repair(damaged(rows)).summary
    every = rows.select("conv_id").distinct()
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


def looped(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth repeats some of its words to its end, by the checksum of its key."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    some = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    some = some.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    some = some.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    head = F.slice("words", F.lit(1), F.col("a").cast("int"))
    loop = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    loops = F.flatten(F.array_repeat(loop, (3 + F.col("g") % 8).cast("int")))
    tail = F.slice(loops, F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text"))
    return some.select("doc_id", text.alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of repeated words of all documents, and the texts without them."""
    found = periodic_runs.periodic_runs(looped(read(spark, sf_dir, "documents")))
    # Runs come by start, then period: the first of equals stays. Fractions are compared exactly.
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over `documents`."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
