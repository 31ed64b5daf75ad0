"""The queries of this subpackage by name, with the SQL that DuckDB can run where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import secrets, toxicity, urls
from panelcast.llm.common import load
from panelcast.llm.decontaminate import contamination
from panelcast.llm.fingerprints import fingerprints
from panelcast.llm.jaccard import jaccard_join
from panelcast.llm.lines import dedup_lines
from panelcast.llm.negatives import hard_negatives
from panelcast.llm.packing import best_fit_packing
from panelcast.llm.ppm import crc_fold, ppm_scores
from panelcast.llm.prefix_trie import conversation_trie
from panelcast.llm.suffixes import remove_repeats
from panelcast.llm.windows import dedup_windows

Query = Callable[[SparkSession, str], DataFrame]

#: Name of the vocabulary file that the packing query uses.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(load(spark, sf_dir, "documents"), crc_fold())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Line dedup as common table expressions over `{table}`; `kept` has each document's remaining lines.
LINE_DEDUP_CTES = """
whole AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {table}),
pairs AS (
  SELECT doc_id, i AS pos, lines[i] || chr(10) || lines[i + 1] AS pair
  FROM whole, unnest(range(1, len(lines))) AS t(i)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY pair ORDER BY doc_id, pos) AS nth FROM pairs),
stretches AS (
  SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS stretch
  FROM ranked WHERE nth > 1),
chunks AS (
  SELECT doc_id, min(pos) AS lo, max(pos) + 1 AS hi FROM stretches GROUP BY doc_id, stretch),
gone AS (
  SELECT doc_id, lo, hi FROM chunks JOIN whole USING (doc_id)
  WHERE len(regexp_extract_all(array_to_string(lines[lo:hi], chr(10)), '[^\\x20\\x09-\\x0D]+')) >= 5),
gone_lines AS (
  SELECT doc_id, unnest(range(lo, hi + 1)) AS line FROM gone),
per_doc AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_removed, list(line) AS dropped FROM gone_lines GROUP BY doc_id),
counted AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_removed_chunks FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
    coalesce(n_removed_chunks, 0) AS n_removed_chunks,
    array_to_string([lines[i] for i in range(1, len(lines) + 1) if dropped IS NULL OR NOT list_contains(dropped, i)], chr(10)) AS text
  FROM whole LEFT JOIN per_doc USING (doc_id) LEFT JOIN counted USING (doc_id))"""


OP2_SQL = f"WITH {LINE_DEDUP_CTES.format(table='documents')} SELECT doc_id, n_lines, n_removed, n_removed_chunks, sha256(text) AS kept_sha256 FROM kept"


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


OP4_SQL = """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, row_number() OVER (ORDER BY item_id, text) AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, text FROM benchmark)),
win AS (
  SELECT item_id, k, j, least(13, len(w)) AS n, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS gram
  FROM item, unnest(range(1, greatest(len(w) - least(13, len(w)) + 2, 1))) AS t(j)
  WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, i, size.n, win.item_id, k, j
  FROM doc, size, unnest(range(1, greatest(len(w) - size.n + 2, 1))) AS t(i)
  JOIN win ON win.n = size.n AND win.gram = array_to_string(w[i:i + size.n - 1], ' ')),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id),
island AS (
  SELECT doc_id, item_id, k, i, n, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, k, i - j ORDER BY i) AS run
  FROM occ),
span AS (
  SELECT doc_id, item_id, min(i) AS place, max(i) - min(i) + max(n) AS words
  FROM island GROUP BY doc_id, item_id, k, diagonal, run),
best AS (
  SELECT doc_id, words, place, item_id FROM span
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, place, item_id) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(best.words, 0) AS BIGINT) AS longest_match, CAST(best.place - 1 AS BIGINT) AS match_place, best.item_id AS match_item
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN best USING (doc_id)
"""


#: Fixed rules of the URL query.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"), urls.train(urls.labelled_urls(spark)), URL_RULES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, toxicity.grade_labels(load(spark, sf_dir, "labels"))))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents"))


OP7_SQL = """
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END)) AS g
  FROM doc),
classes AS (SELECT g, min(doc_id) AS class_id, count(*) AS class_size, len(g) AS n FROM sets GROUP BY g),
grams AS (SELECT class_id, n, unnest(g) AS gram FROM classes),
pairs AS (
  SELECT a.class_id AS a, b.class_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.class_id < b.class_id
  GROUP BY 1, 2, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
mutual AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT reach.a, mutual.b FROM reach JOIN mutual ON reach.b = mutual.a),
roots AS (SELECT a AS class_id, min(b) AS group_id FROM reach GROUP BY 1),
links AS (SELECT a AS class_id, count(*) AS n_links FROM mutual GROUP BY 1)
SELECT doc_id, classes.class_id, class_size, coalesce(n_links, 0) AS n_links, group_id
FROM sets JOIN classes USING (g) JOIN roots ON roots.class_id = classes.class_id LEFT JOIN links ON links.class_id = classes.class_id
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(load(spark, sf_dir, "documents"), vocabulary_path())


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(load(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
c AS (SELECT crc.*, least(crc.h, coalesce(b.n, 0)) AS m FROM crc LEFT JOIN crc b ON b.conv_id = crc.base),
r AS (
  SELECT c.conv_id, pos AS depth, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT conv_id, m + pos - h, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
seq AS (SELECT c.conv_id, coalesce(list(length(role) || ':' || role || length(text) || ':' || text ORDER BY depth) FILTER (WHERE depth IS NOT NULL), []) AS l FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
p AS (
  SELECT x.conv_id, d AS depth, sha256(array_to_string(l[:d], '|')) AS k, sha256(array_to_string(l[:d - 1], '|')) AS pk, d = len(l) AS ends, coalesce(octet_length(encode(text)), 0) AS bytes
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM seq) x LEFT JOIN r ON r.conv_id = x.conv_id AND r.depth = d),
n AS (
  SELECT depth, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) * (count(*) - 1) AS saved, bool_and(ends) AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
named AS (SELECT p.conv_id, depth, n.conv_id AS node FROM p JOIN n USING (depth, k)),
pairs AS (SELECT DISTINCT a.node, a.depth, b.node AS low, b.depth AS low_depth FROM named a JOIN named b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT node, pairs.depth, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved FROM pairs JOIN n ON n.conv_id = low AND n.depth = low_depth GROUP BY 1, 2),
kids AS (SELECT pk, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, CASE WHEN n.depth > 0 THEN up.conv_id END AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN sums ON n.conv_id = node AND n.depth = sums.depth LEFT JOIN n up ON up.depth = n.depth - 1 AND up.k = n.pk LEFT JOIN kids ON kids.pk = n.k AND kids.depth = n.depth
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY rank <= 5
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(load(spark, sf_dir, "documents"))


OP13_SQL = """
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS later
  FROM doc, unnest(range(1, greatest(len(w) - 18, 1))) AS t(i)),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM win WHERE later) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p))), lambda p: w[p]) END, ' '), '')) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id)
"""


QUERIES: dict[str, Query] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op4_benchmark_decontamination": OP4_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op11_conversation_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_substring_dedup": OP13_SQL}
