"""The ten queries over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm import decontaminate, exact_dedup, html, langid, manifest, minhash, packing, pieces, pii, prefix_trie, quality, substring, urls
from hazeline.session import table

#: Fixed values of the URL contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.main_texts(pages, html.fitted(pages))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), RULES)


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages_of(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    both = pieces.decoded(pieces.encoded(table(spark, sf_dir, "documents"), v), v)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    whole = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lower = [*whole[:-1], F.translate("text", string.ascii_uppercase, string.ascii_lowercase)]
    touched = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, manifest.leaf_of(lower))
    m = manifest.manifest(docs, manifest.leaf_of(whole), "lang", "doc_id", carry={"touched": touched})
    again = manifest.folded(F.coalesce("touched", "leaf"), F.col("path"))
    m = m.select("doc_id", "leaf", "subroot", "root", manifest.proof_of(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    own = [op1_main_text, op2_personal_data, op3_url_filter, op4_length_buckets, op5_exact_dedup, op6_quality, op7_language, op8_repeated_windows, op9_near_dedup, op10_decontamination, op11_sentencepiece, op12_merkle_manifest, op13_prefix_trie]
    return {f.__name__: f for f in own}


_OP5 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP8 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(w[pos:pos+19], ' ') ORDER BY doc_id, pos) AS nth FROM p),
gone AS (SELECT DISTINCT doc_id, pos + i AS pos FROM (SELECT doc_id, pos, unnest(range(0, 20)) AS i FROM h WHERE nth > 1)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, count(g.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY word.pos) FILTER (WHERE g.pos IS NULL), '') AS words
         FROM word LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(sh, ' ')) AS s FROM (
      SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [w[i:i+3] for i in range(1, len(w) - 2)] WHEN len(w) > 0 THEN [w] ELSE [] END) AS sh FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT u, v FROM pair JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * x >= 80 * (p.n + q.n - x)),
reach AS (SELECT u, v FROM link UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u),
c AS (SELECT u AS doc_id, min(v) AS least FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _crc32(digits: str) -> str:
    """SQL of the unsigned CRC-32 of a string of ASCII characters, bit by bit."""
    bits = "list_reduce(list_prepend(xor(a, b), [0::BIGINT FOR i IN range(8)]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(ch)::BIGINT FOR ch IN regexp_extract_all({digits}, '.')]), lambda a, b: {bits}), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_LEAF} || {_field("text")}) AS leaf,
      CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({_LEAF} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS touched FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
low AS (SELECT tree, 0 AS k, idx, leaf AS h, n FROM l
        UNION ALL SELECT tree, k + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY tree, k, idx // 8, n),
sub AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (SELECT 0 AS k, rank AS idx, h, n FROM sub
        UNION ALL SELECT k + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY k, idx // 8, n),
every AS (SELECT tree, k, idx, h, n FROM low UNION ALL SELECT '^', k, idx, h, n FROM top),
side AS MATERIALIZED (SELECT tree, k, idx, n, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
      coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM every WINDOW run AS (PARTITION BY tree, k, idx // 8 ORDER BY idx)),
-- a group's root stands for its leaf of the top tree
hop AS MATERIALIZED (SELECT tree, k, idx, a, b, tree AS to_tree, k + 1 AS to_k, idx // 8 AS to_idx FROM side WHERE n > 1
        UNION ALL SELECT s.tree, s.k, s.idx, t.a, t.b, '^', 1, t.idx // 8 FROM side s JOIN sub USING (tree) JOIN side t ON t.tree = '^' AND t.k = 0 AND t.idx = sub.rank WHERE s.n = 1 AND t.n > 1),
walk AS (SELECT tree AS home, idx AS leaf_idx, tree, 0 AS k, idx, '' AS proof, coalesce(touched, leaf) AS h, 0 AS step FROM l
        UNION ALL SELECT home, leaf_idx, to_tree, to_k, to_idx, proof || a || b, sha256(a || h || b), step + 1 FROM walk JOIN hop USING (tree, k, idx)),
fin AS (SELECT home, leaf_idx, arg_max(proof, step) AS proof, arg_max(h, step) AS h FROM walk GROUP BY home, leaf_idx)
SELECT doc_id, leaf, sub.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, fin.h AS folded_root, fin.h = r.h AS verified
FROM l JOIN fin ON fin.home = l.tree AND fin.leaf_idx = l.idx JOIN sub ON sub.tree = l.tree JOIN (SELECT h FROM top WHERE n = 1) r ON true
"""

_OP13 = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT DISTINCT c, c - c % 20 AS base, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h FROM t),
again AS (SELECT conv.c, 0 AS part, nth, role, text FROM conv JOIN t ON t.c = base AND nth <= h UNION ALL SELECT c, 1, nth, role, text FROM t JOIN conv USING (c) WHERE nth > h),
x AS MATERIALIZED (SELECT c, row_number() OVER own AS d, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER own) AS key, coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0) AS words
      FROM again WINDOW own AS (PARTITION BY c ORDER BY part, nth) UNION ALL SELECT c, 0, '', 0 FROM conv),
node AS MATERIALIZED (SELECT key, min(d) AS d, min(c) AS c, count(*) AS n, min(words) AS words FROM x GROUP BY key),
up AS MATERIALIZED (SELECT node.*, p.key AS parent, q.c AS above FROM node LEFT JOIN x p ON p.c = node.c AND p.d = node.d - 1 LEFT JOIN node q ON q.key = p.key),
kid AS (SELECT parent AS key, count(*) AS kids FROM up WHERE parent IS NOT NULL GROUP BY parent),
own AS (SELECT up.*, coalesce(kids, 0) AS kids FROM up LEFT JOIN kid USING (key)),
total AS (SELECT x.key, sum(CAST(kids = 0 AS INT)) AS leaves, sum((n - 1) * own.words) AS saved FROM own JOIN x ON x.c = own.c AND x.d <= own.d GROUP BY x.key),
ends AS (SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(key, d) AS key FROM x GROUP BY c) GROUP BY key)
SELECT c AS conv_id, CAST(d AS BIGINT) AS depth, above AS parent_conv_id, n AS n_convs, kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       coalesce(ends, sha256('')) AS ends_sha256 FROM own JOIN total USING (key) LEFT JOIN ends USING (key)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": _OP5, "op8_repeated_windows": _OP8, "op9_near_dedup": _OP9, "op12_merkle_manifest": _OP12, "op13_prefix_trie": _OP13}
