"""The registered queries of the corpus operators: thin, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .decontaminate import contaminated
from .divergence import audit
from .html_text import extract
from .language_model import train_and_score
from .licenses import scan_licenses
from .lines import dedup_lines
from .packing import pack
from .prefix_trie import prefix_trie, spliced
from .repetition import quality
from .secrets import scan_secrets
from .simhash import near_duplicates
from .urls import filter_urls, named_domains
from .windows import pack_windows


def packing_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.concat_ws(",", c) for c in ("base_labels", "labels")})


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = filter_urls(pages, named_domains(pages))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), packing_tokenizer())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    number = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(number, ("assign", "access", "hex")),
        F.sha2(joined(F.filter("found", lambda x: x.base)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    return prefix_trie(table(spark, sf_dir, "conversations"), copied=lambda turns: spliced(turns, c - c % 100, F.crc32(c.cast("string")) % 6, 5))


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(table(spark, sf_dir, "documents"), packing_tokenizer("byte_bpe_50k.json"))


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op")}


_OP6_SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(name, start, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'allow'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
l AS (SELECT DISTINCT regexp_extract(host, '(?:^|\.)((?:ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\..+)$', 1) AS domain FROM p),
m AS (
  SELECT host, path, arg_max(name || start, length(name || start)) AS rule, arg_max(says, length(name || start)) AS says
  FROM (SELECT DISTINCT host, path FROM p) q, r WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY host, path)
SELECT p.page_id, p.host, p.path, m.rule,
  coalesce(m.says, CASE WHEN EXISTS (SELECT 1 FROM l WHERE domain <> '' AND (p.host = domain OR ends_with(p.host, '.' || domain))) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""


_OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p
  FROM f),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)),
summed AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
every AS (SELECT *, 'pair' AS part FROM pairs UNION ALL BY NAME SELECT *, 'term' AS part FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

_OP12_SQL = """
WITH t AS (
  SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
n AS (SELECT k.*, least(h, coalesce(m, 0)) AS taken FROM k LEFT JOIN (SELECT c AS base, count(*) AS m FROM t GROUP BY c) USING (base)),
r AS (
  SELECT n.c, t.pos, t.digest, t.size FROM n JOIN t ON t.c = n.base AND t.pos <= n.h
  UNION ALL SELECT n.c, t.pos - n.h + n.taken, t.digest, t.size FROM n JOIN t ON t.c = n.c AND t.pos > n.h),
pre AS (
  SELECT c, pos AS d, sha256(string_agg(digest, ',') OVER (PARTITION BY c ORDER BY pos)) AS key, size FROM r
  UNION ALL SELECT c, 0, '', 0 FROM k),
node AS (SELECT d, key, min(c) AS c, count(*) AS w, any_value(size) AS size FROM pre GROUP BY d, key),
up AS (SELECT node.d, node.key, p.key AS parent FROM node JOIN pre p ON p.c = node.c AND p.d = node.d - 1),
kids AS (SELECT d - 1 AS d, parent AS key, count(*) AS n FROM up GROUP BY ALL),
leaf AS (SELECT * FROM node ANTI JOIN kids USING (d, key)),
leaves AS (SELECT pre.d, pre.key, count(*) AS n FROM leaf JOIN pre USING (c) GROUP BY ALL),
saved AS (SELECT pre.d, pre.key, sum((node.w - 1) * node.size) AS n FROM node JOIN pre ON pre.c = node.c AND pre.d <= node.d GROUP BY ALL),
ends AS (
  SELECT d, key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS h
  FROM pre JOIN (SELECT c, max(d) AS d FROM pre GROUP BY c) USING (c, d) GROUP BY d, key)
SELECT node.c AS conv_id, node.d AS depth, above.c AS parent_conv_id, node.w AS n_convs, coalesce(kids.n, 0) AS n_children, leaves.n AS n_leaves,
  saved.n::BIGINT AS saved_tokens, coalesce(ends.h, sha256('')) AS ends_sha256
FROM node LEFT JOIN up USING (d, key) LEFT JOIN node above ON above.d = node.d - 1 AND above.key = up.parent
LEFT JOIN kids USING (d, key) JOIN leaves USING (d, key) JOIN saved USING (d, key) LEFT JOIN ends USING (d, key)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": _OP6_SQL, "op11_source_divergence": _OP11_SQL, "op12_prefix_trie": _OP12_SQL}
