"""Registered queries of the numbered operators, and SQL for those that SQL
can express. Each reads its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featflow.llm import (html_extract, kdtree, merkle, mixing, near_dup, ngram_join, packing, pii, prefix_trie, quality_model, quality_rules, substring,
                          token_store)
from featflow.llm.store import shared_path

END_OF_WORDS = 2        # end id of op6's files
END_OF_BYTES = 0        # end id of op7's pieces


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), texts=False)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = mixing.mix_ledger(_table(spark, sf_dir, "documents"))
    return ledger.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v2").alias("kept"), "failed")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "token-files")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), END_OF_WORDS)
    return token_store.read_tokens(spark, out, crc=True)


def op7_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_OF_BYTES)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(_table(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_duplicates, op2_repeated_passages, op3_source_mix, op4_quality_rules, op5_personal_data,
                            op6_token_files, op7_packed_sequences, op8_main_text, op9_quality_scores, op10_nearest_vectors, op11_conversation_trie,
                            op12_ngram_join, op13_merkle_manifest)}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Unsigned CRC-32 of a string of ASCII characters.
_CRC32 = ("xor(list_reduce(list_prepend(4294967295, flatten([[ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for ch in string_split({}, '')])), "
          "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)")


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


SQL: dict[str, str] = {
    "op1_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 85 * (x.n + y.n - c.c)),
r AS (SELECT a AS node, a AS reached FROM (SELECT DISTINCT a FROM e) UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.m, d.doc_id) AS component_id,
       coalesce(m.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(reached) AS m FROM r GROUP BY node) m ON m.node = d.doc_id""",
    "op2_repeated_passages": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
g AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM p JOIN g USING (h)),
k AS (SELECT t.doc_id, count(*) FILTER (WHERE gone.i IS NOT NULL) AS n_removed,
             string_agg(t.word, ' ' ORDER BY t.i) FILTER (WHERE gone.i IS NULL) AS kept
      FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) t
      LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""",
    "op3_source_mix": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("text")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
c AS (SELECT *, row_number() OVER o AS place, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest,
             1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - (coalesce(sum(source_size) OVER b, 0) * 2)::DOUBLE AS spare
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST),
                    b AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT spare / rest::DOUBLE AS level FROM c WHERE spare / rest::DOUBLE * weight <= 2.0 * source_size ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM l) * weight, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size)::DOUBLE AS target FROM w),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0::DOUBLE END AS rate,
             ('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
    "op4_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
t AS (SELECT doc_id, h FROM g GROUP BY doc_id, h HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM g JOIN t USING (doc_id, h)) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
             len([x for x in ws if octet_length(encode(x)) > 100]) AS n_long_words FROM d),
f AS (SELECT m.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
      FROM m LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
      + CASE WHEN n_words >= 50 AND n_upper > 4 * n_lower THEN 16 ELSE 0 END
      + CASE WHEN word_chars > 20 * n_words OR n_long_words > 0 THEN 32 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM b""",
    "op10_nearest_vectors": """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_conversation_trie": f"""
WITH t AS (SELECT conv_id, length(text) AS size, dg, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS pos
           FROM (SELECT conv_id, turn, coalesce(text, '') AS text,
                        sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg
                 FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY conv_id) b USING (base)),
r AS (SELECT k.conv_id, t.pos AS depth, t.dg, t.size FROM k JOIN t ON t.conv_id = k.base AND t.pos <= k.k
      UNION ALL SELECT k.conv_id, t.pos - k.h + k.k, t.dg, t.size FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos > k.h),
p AS (SELECT conv_id, depth, sha256(string_agg(dg, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS id, size FROM r
      UNION ALL SELECT conv_id, 0, '', 0 FROM k),
q AS (SELECT *, lag(id) OVER o AS parent, lead(id) OVER o IS NULL AS last FROM p WINDOW o AS (PARTITION BY conv_id ORDER BY depth)),
v AS (SELECT depth, id, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM q GROUP BY depth, id),
kids AS (SELECT parent AS id, count(*) AS n FROM v WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT x.id, y.id AS sub FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.depth >= x.depth),
sums AS (SELECT b.id, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((w.n_convs - 1) * w.size) AS saved
         FROM below b JOIN v w ON w.id = b.sub LEFT JOIN kids ON kids.id = b.sub GROUP BY b.id)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, sums.n_leaves,
       sums.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN sums USING (id) LEFT JOIN kids USING (id) LEFT JOIN v u ON u.id = v.parent""",
    "op12_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 85 * (x.n + y.n - c.c)),
r AS (SELECT a AS node, a AS reached FROM (SELECT DISTINCT a FROM e) UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(reached) AS m FROM r GROUP BY node) m ON m.node = d.doc_id""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS other
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (SELECT source, 0 AS level, i, leaf AS d, n FROM placed
          UNION ALL SELECT source, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, i // 3),
subroots AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
above AS (SELECT 0 AS level, i, d, n FROM subroots
          UNION ALL SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM above WHERE n > 1 GROUP BY level, i // 3),
sides AS (SELECT source, level, i, n, coalesce(string_agg(d, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                 coalesce(string_agg(d, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
          FROM nodes WHERE n > 1 WINDOW r AS (PARTITION BY source, level, i // 3 ORDER BY i)),
sides_above AS (SELECT level, i, n, coalesce(string_agg(d, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                       coalesce(string_agg(d, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
                FROM above WHERE n > 1 WINDOW r AS (PARTITION BY level, i // 3 ORDER BY i)),
walk AS (SELECT doc_id, leaf, source, 0 AS level, i, n, other AS d, '' AS proof FROM placed
         UNION ALL
         SELECT w.doc_id, w.leaf, w.source, w.level + 1, w.i // 3, (w.n + 2) // 3, sha256(s.a || w.d || s.b), w.proof || s.a || s.b
         FROM walk w JOIN sides s ON s.source IS NOT DISTINCT FROM w.source AND s.level = w.level AND s.i = w.i),
climb AS (SELECT w.doc_id, w.leaf, r.d AS subroot, 0 AS level, r.i, r.n, w.d, w.proof FROM walk w JOIN subroots r ON r.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
          UNION ALL
          SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.i // 3, (w.n + 2) // 3, sha256(s.a || w.d || s.b), w.proof || s.a || s.b
          FROM climb w JOIN sides_above s ON s.level = w.level AND s.i = w.i)
SELECT c.doc_id, c.leaf, c.subroot, a.d AS root, sha256(c.proof) AS proof_sha256, c.d AS folded_root, c.d = a.d AS verified
FROM climb c JOIN above a ON c.n = 1 AND a.n = 1""",
}
