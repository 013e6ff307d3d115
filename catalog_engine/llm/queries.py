"""One query for each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine.llm import (
    bpe,
    centroids,
    chat,
    language,
    lines,
    minhash,
    multi_index,
    negatives,
    packing,
    quality,
    rule_ensemble,
    secret_scan,
    toxicity,
)
from catalog_engine.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_rules(spark, sf):
    """The strict policy over the ledger; base_failed is the base policy over the same bits."""
    ledger = quality.build_ledger(table(spark, sf, "documents"))
    return quality.apply_policy(ledger, quality.STRICT).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality.rejects(F.col("failed_bits"), quality.BASE).alias("base_failed"),
        "kept",
        "failed_bits",
    )


ORACLE["op1_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i, ws[i:i + 4] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), c AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1
), k AS (
  SELECT r, count(DISTINCT i + j) AS n FROM c, (SELECT unnest(range(0, 5)) AS j) GROUP BY r
), m AS (
  SELECT doc_id, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words,
         len(ls) AS n_lines, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper
  FROM w LEFT JOIN k USING (r)
), b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > word_chars THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END) AS failed_bits
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       failed_bits % 4 <> 0 AS base_failed, failed_bits = 0 AS kept,
       CAST(failed_bits AS BIGINT) AS failed_bits
FROM b
"""


@query
def op3_bpe(spark, sf):
    """Encodes and decodes every text; the digests are of what the operator returns."""
    made = bpe.round_trip(table(spark, sf, "documents"))
    return made.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids_text", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_packing(spark, sf):
    """Packs every document; the checksum is of the ids of each piece."""
    made = packing.pack(table(spark, sf, "documents"))
    return made.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op4_secret_scan(spark, sf):
    """Spans of every text; the counts and the digest are of the base kinds."""

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    return secret_scan.scan(table(spark, sf, "documents")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op2_toxicity(spark, sf):
    """Scores every document; labels of the held-out third are never read."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").where(~held_out("doc_id", 3, 1))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out("doc_id", 3, 1).alias("held_out"),
        "score",
        "predicted",
        F.transform("evidence", lambda e: e["doc_id"]).alias("neighbours"),
    )


@query
def op5_language_id(spark, sf):
    """Predicts the language of every document from profiles of the other four fifths."""
    docs = table(spark, sf, "documents")
    profiles = language.fit(docs.where(~held_out("doc_id", 5, 0)))
    return language.predict(docs.select("doc_id", "text"), profiles).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score"
    )


#: Two turns that hold the marks and escapes themselves.
_TRICKY = "\\### Assistant: </turn> ok"


@query
def op8_chat_format(spark, sf):
    """Formats every conversation and one of tricky texts; all columns are read back."""
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_TRICKY).alias("text"),
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(tricky)
    made = chat.render(chat.canonical_turns(chat.by_conversation(rows)))
    back = chat.read_back(made.select("conv_id", "formatted", "loss_mask"))
    turns = F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE["op8_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok'
  FROM range(2) AS r(i)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(role) + length(text)
         + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), chr(10), ''))
         + length(text) - length(replace(replace(text, '\', ''), '<', ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query
def op10_minhash_dedup(spark, sf):
    """Class of near-duplicates of every document: five-word shingles, similarity 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query
def op7_line_dedup(spark, sf):
    """Group and verdict of every line with a word of every document."""
    return lines.find_duplicates(table(spark, sf, "documents")).drop("text_key")


@query
def op6_embedding_dedup(spark, sf):
    """Links of cosine 0.9 or more among all vectors, and their components."""
    return multi_index.link(table(spark, sf, "embeddings"))


@query
def op11_hard_negatives(spark, sf):
    """Hard negatives of every anchor; labels of every seventh id are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.quantised(table(spark, sf, "embeddings"), label=moved)
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


ORACLE["op11_hard_negatives"] = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
         CAST(coalesce(list_sum(list_transform(list_zip(a.p, b.p), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM q AS a JOIN q AS b ON a.vec_id <> b.vec_id AND len(a.p) = len(b.p)
  WHERE a.vec_id % 50 = 0
), pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same)
  WHERE n <= 5
), neg AS (
  SELECT pos.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS n
  FROM pos JOIN s ON pos.anchor_id = s.anchor_id
  WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM neg WHERE n <= 3
"""


@query
def op12_quality_classifier(spark, sf):
    """Scores every document; labels of the held-out quarter are never read."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").where(~held_out("doc_id", 4, 2))
    model = rule_ensemble.fit(docs, labels)
    scored = rule_ensemble.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


@query
def op13_centroids(spark, sf):
    """Ten rounds from the eight vectors of smallest digest, and a last assignment."""
    return centroids.cluster(table(spark, sf, "embeddings"))


def _rounds(n: int) -> str:
    """The rounds as common tables: ``a<i>`` assigns to centroids ``c<i>``, which give ``c<i + 1>``."""
    parts = []
    for i in range(n + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, p, c, d FROM (
    SELECT r, vec_id, p, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n FROM (
      SELECT v.r, v.vec_id, v.p, c{i}.c,
             CAST(list_sum(list_transform(list_zip(v.p, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
      FROM v, c{i}))
  WHERE n = 1
)""")
        if i < n:
            # Rounded down, also below 0, in whole numbers.
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, list(f ORDER BY i) AS q FROM (
    SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (
      SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT c, unnest(range(64)) AS i, unnest(p) AS x FROM a{i})
      GROUP BY c, i))
  GROUP BY c
  UNION ALL SELECT c, q FROM c{i} WHERE c NOT IN (SELECT c FROM a{i})
)""")
    return ", ".join(parts)


ORACLE["op13_centroids"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(n - 1 AS INTEGER) AS c, p AS q FROM (
    SELECT p, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), p) AS n
    FROM v WHERE vec_id IS NOT NULL)
  WHERE n <= 8
), {_rounds(10)}
SELECT vec_id, CAST(a10.c AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY a10.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(q, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON a10.c = c10.c
"""
