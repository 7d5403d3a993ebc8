"""Registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifespan.llm import alignment, centroids, fm_index, mincut, mixing, multiset, pieces, quality, ranking, records, secret_scan, superminhash, toxicity
from lifespan.llm.common import documents, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_GAP = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array(t, '{_GAP}'), lambda x: x <> '')"
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS} AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(3) AS x(o) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
      FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
             + 8 * (10 * n_dup_lines > 3 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
             + 32 * (word_chars > 15 * n_words)::INT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failures = 0 AS kept,
       CAST(failures AS BIGINT) AS failures FROM f"""


@query("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    entries = quality.ledger(documents(spark, base))
    judged = quality.apply_policy(entries)
    base_failed = F.col("failures").bitwiseAND(F.lit(quality.mask("base-1"))) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "failures"
    )


@query("op3_token_records")
def op3_token_records(spark: SparkSession, base: str) -> DataFrame:
    folder = new_folder(spark, "token-records")
    manifest = records.write_records(documents(spark, base), folder, tokenizer_path(WORD_TOKENIZER), end_id=2)
    read = records.read_records(manifest, folder)
    return read.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))




@query("op4_mix_sources")
def op4_mix_sources(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base)
    sized = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    drawn = mixing.with_copies(sized, mixing.rates(docs))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def piece_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, number of ids and digests of the ids and of the decoded text of every row.

    Null text counts as empty (begin and end alone); ids that are null or repeated stay as they are.
    """
    done = pieces.encode_decode(docs.select("doc_id", "text"), tokenizer_path(PIECE_MODEL))
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, base: str) -> DataFrame:
    return piece_digests(documents(spark, base))


@query("op2_secret_ownership")
def op2_secret_ownership(spark: SparkSession, base: str) -> DataFrame:
    found = secret_scan.spans(documents(spark, base))
    plain = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE))
    n_of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        n_of(0).alias("n_assign"),
        n_of(1).alias("n_access"),
        n_of(2).alias("n_hex"),
        F.sha2(secret_scan.joined(plain), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["copied"])).cast("long").alias("n_copied"),
        F.size(F.filter("spans", lambda s: ~s["copied"])).cast("long").alias("n_live"),
    )


@query("op6_language_centroids")
def op6_language_centroids(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base)
    out = centroids.held_out(F.col("doc_id"))
    model = centroids.fit(docs.filter(~out))
    return centroids.predict(docs.select("doc_id", out.alias("held_out"), "text"), model)


@query("op5_min_cut_text")
def op5_min_cut_text(spark: SparkSession, base: str) -> DataFrame:
    pages = spark.read.parquet(f"{base}/pages.parquet").select("page_id", "url", "html")
    return mincut.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op9_multiset_fingerprint")
def op9_multiset_fingerprint(spark: SparkSession, base: str) -> DataFrame:
    found = multiset.with_next(documents(spark, base))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.base64("fingerprint").alias("fingerprint"),
        F.base64("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '{_GAP}'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY 1) AS m USING (doc_id)"""


@query("op7_superminhash", NEAR_SQL)
def op7_superminhash(spark: SparkSession, base: str) -> DataFrame:
    return superminhash.near_duplicates(documents(spark, base)).select("doc_id", "n_shingles", "component_id", "kept")


REPEATS_SQL = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.replace("(t,", "(coalesce(text, ''),")} AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g),
c AS MATERIALIZED (SELECT DISTINCT doc_id, i + o AS p FROM m, range(13) AS x(o) WHERE least < doc_id),
p AS (SELECT doc_id, ws[k] AS word, k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w)),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n
      FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.k WHERE c.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""


@query("op10_fm_index", REPEATS_SQL)
def op10_fm_index(spark: SparkSession, base: str) -> DataFrame:
    done = fm_index.remove_repeats(documents(spark, base))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, base: str) -> DataFrame:
    path_a, path_b = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_MODEL)
    aligned = alignment.align(documents(spark, base).select("doc_id", "text"), path_a, path_b)
    # an alignment without tokens has no groups to hash
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    kept = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    folder = new_folder(spark, "alignment")
    kept.write.option("compression", "zstd").parquet(folder)
    counted = alignment.with_counts(spark.read.parquet(folder), alignment.base_of(path_b))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_TERMS = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANK_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(t="text")} AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d),
p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY 1, 2),
f AS MATERIALIZED (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 25 + (75 * len(ts) * n_docs) // total AS m FROM d, c WHERE len(ts) > 0),
q AS (SELECT i, item_id, t, count(*) AS times
      FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS.format(t="text")}) AS t FROM benchmark) GROUP BY 1, 2, 3),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


@query("op12_shared_search", RANK_SQL)
def op12_shared_search(spark: SparkSession, base: str) -> DataFrame:
    return ranking.rank(documents(spark, base), spark.read.parquet(f"{base}/benchmark.parquet"))


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{base}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
