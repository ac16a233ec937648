"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def vocabulary(name: str) -> str:
    """Where the public vocabulary file ``name`` is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op4_exact_dedup",
    r"""
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
    WINDOW g AS (PARTITION BY norm)
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.exact_dedup import decide

    return decide(spark, f"{sf_dir}/documents.parquet").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op5_ngram_join")
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.ngram_join import classes

    return classes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


#: A document is kept from this score on.
QUALITY_THRESHOLD = 0.3


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.quality import remainder, scored, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(remainder(F.col("id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


@query("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op8_token_ids")
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.token_files import read, write

    manifest = write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return read(spark, manifest).withColumnRenamed("id", "doc_id")


@query(
    "op1_zip_warc",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
    ), g AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
    FROM g
    """,
)
def op1_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.zip_warc import read, write

    manifest = write(table(spark, sf_dir, "pages"))
    return read(spark, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op2_topk",
    """
    WITH v AS (
        SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
    )
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.topk_search import search

    found = search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


#: The key of the registered query; a real one comes from the job's secrets.
PII_KEY = "keyfold-registered-query"


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.pii import pseudonymise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, PII_KEY, changed_col="n_replaced")


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.spelling import counted, variants

    return variants(counted(table(spark, sf_dir, "documents"), typos=31))


@query(
    "op12_phrase_index",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), b AS (
        SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), win AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS m, w[k:k + least(len(w), 10) - 1] AS run
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
    ), place AS (
        SELECT r, m, p, w[p:p + m - 1] AS run
        FROM (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)
    ), occ AS (SELECT r, p, m, item_id FROM place JOIN win USING (m, run)),
    hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT r, p, m FROM occ)) GROUP BY r),
    held AS (
        SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM occ WHERE item_id IS NOT NULL) GROUP BY r
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
    """,
)
def op12_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.phrase_index import contamination, index, windows

    runs, of_items = windows(table(spark, sf_dir, "benchmark"))
    return contamination(index(table(spark, sf_dir, "documents")), runs, of_items)


@query(
    "op13_phrase_mining",
    r"""
    WITH piece AS (
        SELECT row_number() OVER () AS r, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
    ), total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
    gram AS (
        SELECT lang, m, g, count(*) AS f
        FROM (SELECT lang, m, w[p:p + m - 1] AS g
              FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM piece, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m))
        GROUP BY lang, m, g HAVING count(*) >= 30
    ), cut AS (
        SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f)::HUGEINT AS score
        FROM (SELECT lang, g, m, f, unnest(range(1, m)) AS k FROM gram WHERE m > 1) c
        JOIN gram x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN gram y ON y.lang = c.lang AND y.g = c.g[k + 1:c.m]
    ), low AS (
        SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
    ), inside AS (
        SELECT lang, s, max(f) AS held
        FROM (SELECT lang, f, g[p:p + q - 1] AS s
              FROM (SELECT lang, g, m, f, q, unnest(range(1, m - q + 2)) AS p FROM gram, (SELECT unnest(range(2, 4)) AS q) WHERE q < m))
        GROUP BY lang, s
    ), kept AS (
        SELECT low.*, array_to_string(g, ' ') AS phrase FROM low LEFT JOIN inside ON inside.lang = low.lang AND s = g
        WHERE held IS NULL OR 100::HUGEINT * held < 80::HUGEINT * a
    )
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
    WHERE rank <= 2000
    """,
)
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyfold.llm.phrase_mining import collocations

    return collocations(table(spark, sf_dir, "documents"))
