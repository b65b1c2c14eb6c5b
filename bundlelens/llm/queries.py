"""The registered queries of the training-data operators, each next to its DuckDB text where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from bundlelens.llm import (
    bpe, decontamination, exact_dedup, langid, mixing, preference, quality, secrets, simhash, topk, url_filter, vector_codes, whitening)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)


@query("op1_url_filter", f"""
    WITH parts AS (
      SELECT page_id, url,
        lower(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')) AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
      FROM pages),
    rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
    fits AS (
      SELECT url, rule_host || rule_path AS rule, rule_verdict FROM (SELECT DISTINCT url, host, path FROM parts) p, rules
      WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rule) DESC, length(rule_host) DESC, rule_verdict DESC) = 1)
    SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (url)""")
def url_filter_query(spark, sf_dir):
    """Operator 1 over all pages."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark), carry=["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op2_exact_dedup", r"""
    WITH hashed AS (
      SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
      FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
      row_number() OVER w = 1 AS kept, h AS text_sha256
    FROM hashed WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)""")
def exact_dedup_query(spark, sf_dir):
    """Operator 2 over all documents, against a digest index of its own."""
    with exact_dedup.fresh_index(spark) as index:
        found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index, carry=["doc_id"])
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op3_simhash")
def simhash_query(spark, sf_dir):
    """Operator 3 over all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, carry=["doc_id"])
    return found.select("doc_id", "fingerprint", "component_id")


@query("op4_bpe")
def bpe_query(spark, sf_dir):
    """Operator 4 over all documents: encoded, and the ids decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True, carry=["doc_id"])
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_mixing")
def mixing_query(spark, sf_dir):
    """Operator 5 over all documents."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_preference", """
    WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS n,
        count(*) OVER (PARTITION BY conv_id) AS total
      FROM conversations),
    lasts AS (SELECT conv_id, text FROM turns WHERE n = total),
    pairs AS (SELECT t.conv_id, n, total, role, t.text, coalesce(l.text, '') AS swapped,
        n = total AND t.text <> coalesce(l.text, '') AS differs
      FROM turns t LEFT JOIN lasts l ON l.conv_id = xor(t.conv_id, 1)),
    parts AS (SELECT conv_id, count(*) FILTER (NOT differs) AS n_prompt,
        string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY n) FILTER (NOT differs) AS prompt,
        max('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)) FILTER (differs) AS chosen,
        max('<|' || role || '|>' || chr(10) || swapped || '<|end|>' || chr(10)) FILTER (differs) AS rejected,
        max(CASE WHEN role = 'assistant' THEN '14:' || (14 + length(text) + 8) END) FILTER (differs) AS chosen_mask,
        max(CASE WHEN role = 'assistant' THEN '14:' || (14 + length(swapped) + 8) END) FILTER (differs) AS rejected_mask
      FROM pairs GROUP BY conv_id)
    SELECT conv_id, CAST(n_prompt AS INTEGER) AS n_prompt, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
      coalesce(rejected, '') AS rejected, coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask
    FROM parts""")
def preference_query(spark, sf_dir):
    """Operator 6 over all conversations: each is chosen, and rejected with its neighbour's last turn."""
    turns = table(spark, sf_dir, "conversations")
    return preference.format_preferences(turns, preference.swapped_endings(turns))


@query("op7_top_k", """
    WITH whole AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
      FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    ranked AS (SELECT query_id, vec_id, score,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def top_k_query(spark, sf_dir):
    """Operator 7: vectors whose id is divisible by 50 against all."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def held_out(key: str = "doc_id"):
    """Documents that a language model never learns from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op8_language_id")
def language_query(spark, sf_dir):
    """Operator 8 over all documents."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~held_out())
    found = langid.identify(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op9_quality")
def quality_query(spark, sf_dir):
    """Operator 9 over all documents, fitted on graded labels: a point each for quality and for not being toxic."""
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    rated = quality.rate(docs.select("doc_id", "text"), quality.train(docs, ratings), carry=["doc_id"])
    return rated.select("doc_id", "expected_grade", "tail", "kept")


@query("op10_secrets")
def secrets_query(spark, sf_dir):
    """Operator 10 over all documents."""
    scanned = secrets.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return secrets.with_digests(scanned).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "unread")


def _rounds(rounds: int) -> str:
    """The unrolled rounds of operator 11 as SQL: nearest entries, then the moved codebook."""
    near = """near{k} AS MATERIALIZED (
        SELECT r, p, min(dist * 256 + e) AS best FROM (
          SELECT d.r, d.p, b.e, CAST(sum((d.x - b.x) * (d.x - b.x)) AS BIGINT) AS dist
          FROM dims d JOIN book{k} b ON d.p = b.p AND d.i = b.i GROUP BY d.r, d.p, b.e) GROUP BY r, p)"""
    book = """book{n} AS MATERIALIZED (
        SELECT b.p, b.e, b.i, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
          SELECT n.p, n.best % 256 AS e, d.i, CAST((sum(d.x) - ((sum(d.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
          FROM near{k} n JOIN dims d ON n.r = d.r AND n.p = d.p GROUP BY n.p, n.best % 256, d.i) m USING (p, e, i))"""
    return ",\n".join([part for k in range(rounds) for part in (near.format(k=k), book.format(k=k, n=k + 1))] + [near.format(k=rounds)])


@query("op11_vector_codes", f"""
    WITH whole AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
        [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    dims AS MATERIALIZED (
      SELECT r, pos // (n // 4) AS p, pos % (n // 4) AS i, x FROM (
        SELECT r, len(v) AS n, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM whole)),
    book0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, x FROM dims WHERE r <= 256),
    {_rounds(4)},
    codes AS (SELECT r, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error
      FROM near4 GROUP BY r)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM book4) AS codebooks_sha256
    FROM whole JOIN codes USING (r)""")
def vector_codes_query(spark, sf_dir):
    """Operator 11 over all embeddings: 4 parts of 256 entries, 4 rounds."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), carry=["vec_id"])


@query("op12_whitening")
def whitening_query(spark, sf_dir):
    """Operator 12 over all embeddings: the first 4 components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, carry=["vec_id"])


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_GRAMS = ",\n        ".join(" || ' ' || ".join(["w"] + [f"lead(w, {j}) OVER o" for j in range(1, k)]) + f" AS g{k}" for k in range(1, 11))
_GRAM = " ".join(f"WHEN {k} THEN g{k}" for k in range(1, 11))


@query("op13_decontamination", f"""
    WITH items AS (SELECT row_number() OVER () AS r, item_id, {_WORDS} AS all_words FROM benchmark),
    item_words AS (SELECT r, item_id, len(all_words) AS n, unnest(all_words) AS w, unnest(range(0, len(all_words))) AS i FROM items),
    item_grams AS (SELECT item_id, n, {_GRAMS} FROM item_words WINDOW o AS (PARTITION BY r ORDER BY i)),
    windows AS (SELECT DISTINCT item_id, least(n, 10) AS k, CASE least(n, 10) {_GRAM} END AS gram FROM item_grams),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS all_words FROM documents),
    doc_words AS (SELECT r, unnest(all_words) AS w, unnest(range(0, len(all_words))) AS i FROM docs),
    doc_grams AS MATERIALIZED (SELECT r, i, {_GRAMS} FROM doc_words WINDOW o AS (PARTITION BY r ORDER BY i)),
    found AS MATERIALIZED (
      SELECT r, i, k, item_id FROM (SELECT r, i, k, CASE k {_GRAM} END AS gram FROM doc_grams, (SELECT DISTINCT k FROM windows))
      JOIN windows USING (k, gram) WHERE gram IS NOT NULL),
    hits AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r),
    listed AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(all_words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)""")
def decontamination_query(spark, sf_dir):
    """Operator 13: all documents against all items of the benchmark, windows of 10 words."""
    found = decontamination.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


query("pipeline")(corpus_pipeline.run)
