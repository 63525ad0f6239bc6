"""Queries of this subpackage, one per operator, with DuckDB SQL where SQL can express them.

op1 (tokenizer), op2 (byte strings and digests over whole tables), op4 (a trained model), op5 (tokenizer), op9 (an
approximate search), op12 (tokenizer) and the pipeline have none; tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, centroids, chat, collision_ann, decontaminate, mixing, ngram_join, ranked_search, suffix_dedup, token_counts, token_files, toxicity, warc
from .common import table

WORDS = "[^\\x20\\x09-\\x0D]+"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents with Elias-Fano boundaries, as read back from the files."""
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 50-byte strings of documents with smaller ids cover."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingle sets have Jaccard similarity of 0.8 or more."""
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by non-negative positive-unlabelled learning."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram of all documents with suffix sums for every context limit."""
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, normalised to a member per record, as read back from the archives."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: 0.8 or more of the item's five-word shingles."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights by systematic sampling."""
    return mixing.plan(table(spark, sf_dir, "documents")).drop("copies")


def op9_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors, by inner product, of every vector whose id divides by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return collision_ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    return chat.round_trip(chat.probe(spark, table(spark, sf_dir, "conversations")))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 8 clusters after 10 rounds, in integers."""
    return centroids.summary(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the ranks of a byte-level vocabulary and decoded again."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that score highest for every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Lower-cases A-Z only, as the operator does.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORDS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1
"""

_OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS best FROM d WHERE n >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT d.page_id, d.n AS payload_bytes, d.h AS payload_digest,
  CASE WHEN m.best IS NULL OR d.page_id = m.best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id IS DISTINCT FROM m.best THEN m.best END AS refers_to
FROM d LEFT JOIN m ON d.h = m.h
"""

_OP7 = f"""
WITH w AS (
  SELECT 'd' AS t, doc_id AS id, regexp_extract_all({_LOWER}, '{WORDS}') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all({_LOWER}, '{WORDS}') FROM benchmark),
s AS (
  SELECT DISTINCT t, id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT t, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE t = 'i' GROUP BY 1),
f AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c FROM s d JOIN s i ON d.g = i.g AND d.t = 'd' AND i.t = 'i' GROUP BY 1, 2)
SELECT f.doc_id, f.item_id, n.n AS n_item, f.c AS n_found, f.c / n.n AS containment
FROM f JOIN n ON n.id = f.item_id WHERE 10 * f.c >= 8 * n.n
"""

#: Sources whose share passes their limit are capped one round after the other; the level only rises, so this ends.
MIXED = r"""
z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
w AS (SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM t),
lv AS (
  SELECT 0 AS step, (SELECT sum(source_size)::BIGINT FROM w) AS rest, (SELECT sum(weight)::BIGINT FROM w) AS weights
  UNION
  SELECT step + 1,
    (SELECT sum(source_size)::BIGINT FROM w) - coalesce((SELECT sum(3 * source_size)::BIGINT FROM w WHERE lv.rest::DOUBLE * weight / lv.weights::DOUBLE > 3 * source_size), 0),
    (SELECT sum(weight)::BIGINT FROM w) - coalesce((SELECT sum(weight)::BIGINT FROM w WHERE lv.rest::DOUBLE * weight / lv.weights::DOUBLE > 3 * source_size), 0)
  FROM lv WHERE step < (SELECT count(*) FROM w) AND weights > 0),
l AS (SELECT rest, weights FROM lv ORDER BY step DESC LIMIT 1),
g AS (
  SELECT source, source_size, CASE WHEN weights = 0 THEN 3.0 * source_size ELSE least(3.0 * source_size, rest::DOUBLE * weight / weights::DOUBLE) END::DOUBLE AS target,
    ('0x' || substr(md5('mix/' || coalesce('=' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM w, l),
k AS (
  SELECT z.doc_id, z.source, z.size, g.source_size, g.target, g.u, CASE WHEN g.source_size > 0 THEN g.target / g.source_size::DOUBLE ELSE 0.0 END::DOUBLE AS rate,
    row_number() OVER (PARTITION BY z.source ORDER BY z.size, z.doc_id) AS r
  FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source),
mixed AS (
  SELECT doc_id, size, source_size, target, (floor(rate * r::DOUBLE + u) - floor(rate * (r - 1)::DOUBLE + u))::BIGINT AS copies FROM k)
"""

_OP8 = "WITH RECURSIVE " + MIXED.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"

#: A text is escaped if it holds its own closing mark or what the parser would take for an escape.
_OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '</s>' WHEN 'system' THEN '<</SYS>>' ELSE '<</ROLE>>' END AS close,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 15 ELSE 18 + length(role) END AS marks
  FROM c),
e AS (
  SELECT *, CASE WHEN contains(text, close) OR regexp_matches(text, '[\[<]\\+(/?INST\]|/?s>|<ANS>>|</?SYS>>|<ROLE:|</ROLE>>)')
    THEN len(regexp_extract_all(text, '[\[<]\\*(/?INST\]|/?s>|<ANS>>|</?SYS>>|<ROLE:|</ROLE>>)')) ELSE 0 END AS more
  FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(text) + marks + more))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

def _op11(rounds: int = 10, clusters: int = 8, dimensions: int = 64) -> str:
    """Rounds are written out one after the other."""
    steps = f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dimensions}),
v AS MATERIALIZED (SELECT r, vec_id, unnest(range(1, {dimensions} + 1)) AS d, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS k FROM e WHERE vec_id IS NOT NULL QUALIFY k < {clusters}),
c0 AS MATERIALIZED (SELECT k, d, x AS c FROM v JOIN s USING (r))"""
    for i in range(rounds + 1):
        steps += f""",
p{i} AS (SELECT r, k, sum((x - c) * (x - c))::BIGINT AS w FROM v JOIN c{i} USING (d) GROUP BY r, k),
a{i} AS MATERIALIZED (SELECT r, k, w FROM p{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY w, k) = 1)"""
        if i < rounds:
            steps += f""",
m{i} AS (SELECT k, d, sum(x) AS t, count(*) AS n FROM v JOIN a{i} USING (r) GROUP BY k, d),
c{i + 1} AS MATERIALIZED (SELECT k, d, CASE WHEN n IS NULL THEN c ELSE ((t - ((t % n) + n) % n) // n)::BIGINT END AS c FROM c{i} LEFT JOIN m{i} USING (k, d))"""
    return steps + f"""
SELECT vec_id, k::INTEGER AS cluster, w AS distance, (sum(w) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(w) OVER ())::BIGINT AS inertia,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY d)) FROM c{rounds} z WHERE z.k = a{rounds}.k) AS centroid_sha256
FROM a{rounds} JOIN e USING (r)
"""


_OP13 = r"""
WITH q AS (
  SELECT DISTINCT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
n AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM n),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, g GROUP BY term, nn),
p AS (SELECT t.r, t.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // l))) AS part FROM t JOIN w USING (term) JOIN n USING (r), g),
s AS (SELECT item_id, text, r, sum(part)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY 1, 2, 3 HAVING sum(part) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score
FROM s JOIN n USING (r) QUALIFY rank <= 50
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_files, op2_suffix_dedup, op3_ngram_jaccard_join, op4_toxicity, op5_token_counts, op6_warc, op7_decontaminate, op8_mixing, op9_collision_ann, op10_chat, op11_centroids, op12_byte_bpe, op13_ranked_search)
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op3_ngram_jaccard_join": _OP3, "op6_warc": _OP6, "op7_decontaminate": _OP7, "op8_mixing": _OP8, "op10_chat": _OP10, "op11_centroids": _op11(), "op13_ranked_search": _OP13}
