"""One query per training-data operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fitloom.llm.bag_minhash import near_duplicates
from fitloom.llm.common import table
from fitloom.llm.hnsw_dedup import near_vectors
from fitloom.llm.html_wrappers import extract
from fitloom.llm.kd_shards import kd_shards
from fitloom.llm.language_id import identify
from fitloom.llm.line_dedup import dedup_lines
from fitloom.llm.mixing import mix
from fitloom.llm.packing import pack
from fitloom.llm.pii import digest
from fitloom.llm.prefix_trie import prefix_trie
from fitloom.llm.quality_rules import judge
from fitloom.llm.substring_dedup import dedup_substrings
from fitloom.llm.token_alignment import align


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chunks", "n_removed")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), n_shards=16)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken")


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def op8_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("enter_at", "exit_at")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bag_minhash": op1_bag_minhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_kd_shards": op3_kd_shards,
    "op4_mixing": op4_mixing,
    "op5_html_wrappers": op5_html_wrappers,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_hnsw_dedup": op8_hnsw_dedup,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_substring_dedup": op13_substring_dedup,
}

# The mixture as plain windows: one running sum per source instead of bucket sums and a border bucket.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>{}]')) AS symbols, md5(coalesce(text, '')) AS text_key FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || text_key), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
    / greatest(0.05, 1.0 - symbols / CAST(greatest(size, 1) AS DOUBLE)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level <= cap / w), 'inf'::DOUBLE) * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
x AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size, text_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * least(epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken FROM x"""

# Line dedup with lines and chunks as rows; the first chunk of equal bytes stays.
OP2_SQL = r"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?s).*?(?:\n|[.!?] )|.+') AS p FROM documents),
q AS (SELECT doc_id, flatten(list_transform(p, lambda s: CASE WHEN length(s) > 160
  THEN regexp_extract_all(s, '(?s).{80}[^\x20\x09-\x0D]{0,40}[\x20\x09-\x0D]*|.+') ELSE [s] END)) AS q FROM p),
l AS (SELECT doc_id, unnest(q) AS s, generate_subscripts(q, 1) AS i FROM q),
w AS (SELECT *, rtrim(s, chr(10)) AS b, lead(rtrim(s, chr(10))) OVER d AS nb, length(s) AS c, lead(length(s)) OVER d AS nc FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, count(*) OVER (PARTITION BY b, nb) AS n FROM w WHERE nb IS NOT NULL),
f AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM n WHERE n > 1),
r AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS z FROM f GROUP BY doc_id, island HAVING sum(c) + max_by(nc, i) >= 120),
x AS (SELECT l.*, a, md5(rtrim(s, chr(10))) AS h FROM l JOIN r ON l.doc_id = r.doc_id AND i BETWEEN a AND z),
m AS (SELECT *, md5(lag(h) OVER d || h) AS mark FROM x WINDOW d AS (PARTITION BY doc_id, a ORDER BY i)),
e AS (SELECT *, coalesce(mark < lag(mark) OVER d AND mark < lead(mark) OVER d AND lead(i, 2) OVER d IS NOT NULL, false) AS ends
  FROM m WINDOW d AS (PARTITION BY doc_id, a ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, a ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
c AS (SELECT doc_id, min(i) AS begin, max(i) AS until, rtrim(string_agg(s, '' ORDER BY i), chr(10)) AS body FROM k GROUP BY doc_id, a, chunk),
o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, begin) > 1 AS gone FROM c),
g AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS n_removed FROM o GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(s, '' ORDER BY i) AS text FROM l LEFT JOIN o ON o.gone AND o.doc_id = l.doc_id AND i BETWEEN begin AND until
  WHERE o.doc_id IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text,
  CAST(coalesce(n_chunks, 0) AS INTEGER) AS n_chunks, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)"""

# Brute force over all pairs with a common shingle, then reachability.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
b AS (SELECT doc_id, s, count(*) AS n FROM s GROUP BY doc_id, s),
t AS (SELECT doc_id, sum(n) AS total FROM b GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS common FROM b x JOIN b y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE common / (x.total + y.total - common) >= 0.8),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM r GROUP BY a"""

# Brute force over all pairs of vectors, then reachability.
OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a"""

# The trie with whole paths as keys; subtrees by joining every node with all nodes above it. CRC-32 bit by bit.
OP12_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)),
      4294967295::BIGINT) % 9 AS h FROM t GROUP BY conv_id),
p AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS p FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT p.conv_id, t.pos AS depth, role, text FROM p JOIN t ON t.conv_id = p.base AND t.pos <= p.p
  UNION ALL SELECT p.conv_id, p.p + t.pos - p.h, role, text FROM p JOIN t ON t.conv_id = p.conv_id AND t.pos > p.h),
m AS (SELECT conv_id, 0 AS depth, 0 AS bytes, '' AS path FROM c UNION ALL SELECT conv_id, depth, strlen(text),
    string_agg(len(role) || ':' || role || len(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) FROM r),
n AS (SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(bytes) AS bytes FROM m GROUP BY path),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS length FROM m) WHERE depth = length GROUP BY path),
u AS (SELECT n.*, above.path AS parent FROM n LEFT JOIN m above ON above.conv_id = n.conv_id AND above.depth = n.depth - 1),
k AS (SELECT parent AS path, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT a.path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved
  FROM u LEFT JOIN k ON k.path = u.path JOIN m a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.path)
SELECT u.conv_id, CAST(u.depth AS BIGINT) AS depth, x.conv_id AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM u LEFT JOIN n x ON x.path = u.parent LEFT JOIN k ON k.path = u.path LEFT JOIN e ON e.path = u.path JOIN s ON s.path = u.path"""

# All windows of 50 words as rows; a window's first document is the least one that holds it.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
c AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM x JOIN f USING (h) WHERE least < doc_id),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.j) FILTER (WHERE c.j IS NULL) AS kept, count(c.j) AS n_removed
  FROM p LEFT JOIN c ON c.r = p.r AND c.j = p.j GROUP BY p.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""

ORACLES: dict[str, str] = {"op1_bag_minhash": OP1_SQL, "op2_line_dedup": OP2_SQL, "op4_mixing": OP4_SQL, "op8_hnsw_dedup": OP8_SQL,
                           "op12_prefix_trie": OP12_SQL, "op13_substring_dedup": OP13_SQL}
