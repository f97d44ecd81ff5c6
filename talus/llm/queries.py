"""One query for each operator of this subpackage, over whole tables with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, mixing, secrets, simhash, tokens, topk, toxicity, urls, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@query(
    "op1_exact_top_k",
    """
WITH e AS (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) AS bigint)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.row_id, q.vec_id AS query_id, r.vec_id, cast(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS bigint) AS score
      FROM e q JOIN e r ON q.row_id <> r.row_id WHERE q.vec_id % 20 = 0)
SELECT query_id, cast(n AS integer) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS n FROM p) WHERE n <= 20
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each query; rows without a valid vector take no part, rows that repeat are rows each (``topk.top_k``)."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty html give an empty one (``extract.extract``)."""
    return extract.extract(table(spark, sf_dir, "pages"))


@query(
    "op3_benchmark_decontamination",
    f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
       FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0)),
dw AS (SELECT row_id, n, unnest(range(1, len(w) - n + 2)) AS p,
              unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
       FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT row_id, p, dw.n, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT row_id, count(DISTINCT q) AS n_hit FROM (SELECT row_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY ALL),
i AS (SELECT row_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT row_id, cast(item_id AS varchar) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY ALL)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
       cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d
LEFT JOIN c USING (row_id) LEFT JOIN i USING (row_id)
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark passages; null and empty texts have none, rows that repeat stay (``decontaminate.decontaminate``)."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op4_simhash_near_duplicates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts have fingerprint zero and are linked as any other (``simhash.near_duplicates``)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in urls.RULES)


@query(
    "op5_url_filters",
    f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT row_number() OVER () AS row_id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(verdict, host, path) AS (VALUES {_RULES}),
f AS (SELECT h.row_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
      FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY h.row_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN f USING (row_id)
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; a null one, or one without a scheme, has an empty host and path and is allowed (``urls.filter_urls``)."""
    return urls.filter_urls(table(spark, sf_dir, "pages"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document; null and empty texts are scored as texts without words (``toxicity.toxicity``)."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document; null and empty texts have no tokens (``tokens.token_counts``)."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query(
    "op8_source_mixing",
    """
WITH q AS (SELECT doc_id, max(1 + quality) AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
r AS (SELECT d.doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size,
             (cast('0x' || substr(md5(coalesce(cast(d.doc_id AS varchar), text, '')), 1, 12) AS bigint) + 1.0::double) / 281474976710656.0::double AS unit,
             coalesce(weight, 1)::double AS weight
      FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
k AS (SELECT *, -ln(unit) / weight AS key FROM r),
s AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) AS turn FROM k GROUP BY source),
w AS (SELECT *, ((turn - 1) % 3 + 1) AS weight, 3 * source_size AS stop FROM s),
v AS (SELECT *, row_number() OVER o AS nth,
             (sum(source_size) OVER () - coalesce(sum(stop) OVER p, 0))::double / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::double AS level
      FROM w WINDOW o AS (ORDER BY stop::double / weight, source NULLS LAST),
                    p AS (ORDER BY stop::double / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(stop::double, coalesce((SELECT min_by(level, nth) FROM v WHERE stop::double / weight >= level) * weight, stop::double)) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::bigint ELSE 0 END AS epochs FROM t),
c AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - (e.epochs * e.source_size)::double AS rest,
             sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::bigint AS size, source_size, target,
       (size * (epochs + CASE WHEN upto::double - size::double / 2 <= rest THEN 1 ELSE 0 END))::bigint AS taken
FROM c
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; a null text has size 0, a null source is a source (``mixing.mix``)."""
    quality = table(spark, sf_dir, "labels").select("doc_id", (1 + F.col("quality")).alias("weight"))
    return mixing.mix(table(spark, sf_dir, "documents"), quality)


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((('0x' || substr(sha, {5 * i + 1}, 5))::bigint >> {15 - 5 * j}) & 31) + 1 AS integer), 1)" for i in range(8) for j in range(4)
)


@query(
    "op9_warc",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, sha1(html) AS sha, octet_length(encode(html)) AS payload_bytes FROM p),
f AS (SELECT sha, max(page_id) AS first FROM d GROUP BY sha)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (sha)
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written and read back; null html is an empty payload, ties for the largest page_id are all responses (``warc.archive``)."""
    return warc.archive(table(spark, sf_dir, "pages"))


@query("op10_secret_scans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document; a null text has none (``secrets.secrets``)."""
    return secrets.secrets(table(spark, sf_dir, "documents"))
