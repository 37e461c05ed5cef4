"""The operators' queries over the test tables, with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, chat, filter_audit, fingerprints, langid, line_dedup, ngram_join, packing, suffix_dedup, token_counts, token_files
from ._common import shared_folder, swept, table


def _bytes_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), *_bytes_vocabulary())


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, similarity=Fraction(9, 10))


def op3_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of op3 with all its links counted."""
    return ngram_join.link_counts(table(spark, sf_dir, "documents"), k=3, similarity=Fraction(9, 10))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op6_line_dedup_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 with short texts and wordy runs of one or two lines, as the pipeline's stage has it."""
    return line_dedup.digests(table(spark, sf_dir, "documents"), words=line_dedup.WORDS)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_CONTROL = "<|im_end|><|im_start|>assistant ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)], turns.schema)
    return chat.read_back(chat.format_log(chat.events_of_turns(turns.unionByName(planted))))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(table(spark, sf_dir, "documents"), *_bytes_vocabulary())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    swept(spark, path)
    token_files.write_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.digests(spark, path)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_nearest_neighbours, op3_ngram_jaccard, op3_ngram_links, op4_language_id, op5_suffix_dedup, op6_line_dedup, op6_line_dedup_short, op7_packing, op8_chat_formatting, op9_fingerprints, op10_byte_bpe, op11_filter_audit, op12_token_files, op13_token_alignment,
    )
}



def _tree(text: str) -> str:
    """DuckDB: leaf digests by section and paragraph."""
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{fingerprints.LEAF}'), lambda x: md5(x))))"


def _digests(lists: str, depth: int) -> str:
    """DuckDB: SHA-256 of the digests in each list of lists."""
    each = "lambda s: sha256(array_to_string(s, ''))"
    return f"list_transform({lists}, {each})" if depth == 1 else f"list_transform({lists}, lambda x: list_transform(x, {each}))"


ORACLE_SQL: dict[str, str] = {
    "op11_filter_audit": r"""
WITH RECURSIVE l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(least < w.doc_id, false)} AS f
  FROM w LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, good, toxic, concat(if(f.A, 'A', ''), if(f.B, 'B', ''), if(f.C, 'C', ''), if(f.D, 'D', ''), if(f.E, 'E', '')) AS fails, count(*) AS n FROM d GROUP BY ALL
), o AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(x) WHERE length(o) < 5 AND NOT contains(o, x)
), s AS (
  SELECT o AS filter_order, CAST(i AS INTEGER) AS step, substring(o, i, 1) AS x, substring(o, 1, i - 1) AS before FROM o, range(1, 6) r(i) WHERE length(o) = 5
), c AS (
  SELECT *, contains(fails, x) AS own, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM m, s
), g AS (
  SELECT part, filter_order, step, x, CAST(coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (own AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (own AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = x), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (own AND NOT gone AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (own AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM c GROUP BY ALL
)
SELECT * EXCLUDE x, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g
""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), g AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
""",
    "op3_ngram_links": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), g AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, count(link.b) AS n_links
FROM s LEFT JOIN link ON link.a = s.doc_id GROUP BY s.doc_id, s.s
""",
    "op5_suffix_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM w WHERE len(w) >= 50),
r AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1 : pos + 50], ' ')) AS run FROM p),
f AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY run) AS n,
    first_value(doc_id) OVER (PARTITION BY run ORDER BY doc_id, pos) AS d0, first_value(pos) OVER (PARTITION BY run ORDER BY doc_id, pos) AS p0 FROM r
), j AS (SELECT doc_id, pos, doc_id = d0 AND pos < p0 + 50 AS is_first FROM f WHERE n > 1),
k AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, is_first ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM j),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, is_first ORDER BY pos) AS island FROM k)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 50 AS BIGINT) AS stop, is_first FROM i GROUP BY doc_id, is_first, island
""",
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents
), t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS pos FROM t WHERE bare <> ''),
r AS (
  SELECT doc_id, pos, bare || chr(10) || lead(bare, 1) OVER o || chr(10) || lead(bare, 2) OVER o AS run FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), f AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS d0, first_value(pos) OVER w AS p0 FROM r WHERE run IS NOT NULL WINDOW w AS (PARTITION BY run ORDER BY doc_id, pos)
), dead AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM f WHERE NOT (doc_id = d0 AND pos < p0 + 3)),
k AS (
  SELECT t.doc_id, t.no, t.line, u.pos, dead.pos IS NOT NULL AS gone FROM t LEFT JOIN u ON t.doc_id = u.doc_id AND t.no = u.no
  LEFT JOIN dead ON dead.doc_id = t.doc_id AND dead.pos = u.pos
)
SELECT doc_id, count(pos) AS n_lines, count(*) FILTER (gone) AS deleted_lines,
  length(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
""",
    "op8_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), escaped AS (
  SELECT *, 12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 10 + 1 AS size FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op9_fingerprints": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM documents
), e AS (
  SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited FROM d
), t AS (
  SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_tree("text")} AS t, {_tree("edited")} AS e, {_tree("next_text")} AS n FROM e
), p AS (
  SELECT *, list_distinct(flatten(flatten(t))) AS a, list_distinct(flatten(flatten(e))) AS b, list_distinct(flatten(flatten(n))) AS c, {_digests("t", 2)} AS p, {_digests("e", 2)} AS q FROM t
), s AS (
  SELECT *, {_digests("p", 1)} AS s, {_digests("q", 1)} AS z FROM p
), f AS (
  SELECT *, list_filter(range(greatest(len(s), len(z))), lambda i: s[i + 1] IS DISTINCT FROM z[i + 1])[1] AS spot,
    flatten(list_filter(p, lambda x: NOT list_contains(q, x))) AS own, flatten(list_filter(q, lambda x: NOT list_contains(p, x))) AS other FROM s
)
SELECT doc_id, n_chars, edited_sha256, sha256(array_to_string(s, '')) AS fingerprint, sha256(array_to_string(z, '')) AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, c)) / (len(a) + len(c)) END AS near_next,
  CAST(len(list_filter(list_distinct(own), lambda x: NOT list_contains(other, x))) AS BIGINT) AS differing, spot AS edit_section,
  list_filter(range(greatest(coalesce(len(p[spot + 1]), 0), coalesce(len(q[spot + 1]), 0))), lambda i: p[spot + 1][i + 1] IS DISTINCT FROM q[spot + 1][i + 1])[1] AS edit_paragraph
FROM f
""",
}
