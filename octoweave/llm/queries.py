"""The registered query of each operator, over its whole table, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import table
from .dartminhash import near_dedup
from .decontaminate import leaks
from .licenses import LOWER, PHRASES, UPPER, scan, template_sets
from .line_dedup import line_dedup
from .mixing import mix
from .passages import passage_dedup
from .quality import quality
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op2_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_removed_").alias("n_removed"), F.md5("text").alias("kept_md5"))


def op4_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op8_gated_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(table(spark, sf_dir, "documents"))


def op9_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), texts=False)


#: For sources of one shard each, a million words; larger ones are dealt to shards by a hash that SQL does not have.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws('|', '17', doc_id, md5(text))) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(i - 1) % 3 + 1] AS w, CAST(sum(n) OVER () AS BIGINT) AS t, greatest(1, least(64, CAST(sum(n) OVER () AS BIGINT) // 4096)) AS blk FROM s),
c AS (SELECT *, 3 * n / CAST(w AS DOUBLE) AS cap FROM w WHERE n > 0),
l AS (SELECT *, (t - coalesce(sum(3 * n) OVER (ORDER BY cap, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(w) OVER (ORDER BY cap, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM c),
v AS (SELECT min_by(lev, (cap, i)) AS lev FROM l WHERE lev <= cap),
g AS (SELECT w.*, CASE WHEN w.n = 0 THEN 0.0::DOUBLE ELSE least(3.0::DOUBLE * w.n, w.w * v.lev) END AS target FROM w, v),
q AS (SELECT source, i, blk, t, target / (2 * k + 1) AS quotient FROM (SELECT *, unnest(range(CAST(ceil(target / blk) AS BIGINT) + 2)) AS k FROM g)),
k AS (SELECT i, count(*) AS seats FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, i) AS r FROM q) WHERE r <= t // blk GROUP BY i),
z AS (SELECT g.*, least(coalesce(seats, 0) * blk, 3 * n) AS quota FROM g LEFT JOIN k ON g.i = k.i),
r AS (SELECT d.doc_id, d.size, z.n, z.target, z.quota, CASE WHEN z.n > 0 THEN z.quota // z.n ELSE 0 END AS passes, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before
      FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target, CAST(passes * size + greatest(0, least(size, quota - passes * n - before)) AS BIGINT) AS taken FROM r
"""


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
b AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d)),
c AS (SELECT b.doc_id, b.p, b.x, max(f.p) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM b LEFT JOIN f ON b.doc_id = f.doc_id AND b.p = f.p),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS head FROM c),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans, sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


OP2_SQL = """
WITH l AS (SELECT doc_id, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
n AS (SELECT doc_id, line, trim(raw) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS p FROM l WHERE trim(raw) <> ''),
w AS (SELECT a.doc_id, a.p, a.line AS l1, b.line AS l2, c.line AS l3, a.c AS c1, b.c AS c2, c.c AS c3
      FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.p = a.p + 1 JOIN n c ON a.doc_id = c.doc_id AND c.p = a.p + 2),
o AS (SELECT *, row_number() OVER (PARTITION BY c1, c2, c3 ORDER BY doc_id, p) AS nth FROM w),
g AS (SELECT DISTINCT doc_id, unnest([l1, l2, l3]) AS line FROM o WHERE nth > 1),
k AS (SELECT l.doc_id, count(*) FILTER (trim(raw) <> '') AS n_lines, count(g.line) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, CAST(k.n_lines AS INT) AS n_lines, CAST(k.n_removed AS INT) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE md5(k.kept) END AS kept_md5 FROM documents d JOIN k USING (doc_id)
"""


OP7_SQL = """
WITH t AS (SELECT * FROM (VALUES {templates}) AS t(template, label, words, need, width)),
ph AS (SELECT * FROM (VALUES {phrases}) AS ph(phrase, label)),
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, i, label, len(string_split(phrase, ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d) x JOIN ph
       ON array_to_string(list_slice(w, i + 1, i + len(string_split(phrase, ' '))), ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list_distinct(list(label)) AS labels FROM places GROUP BY doc_id),
l AS (SELECT doc_id, width, list_slice(w, j * width + 1, (j + 2) * width) AS w FROM (SELECT doc_id, w, width, unnest(range((len(w) + width - 1) // width)) AS j FROM d, (SELECT DISTINCT width FROM t))),
m AS (SELECT doc_id, label, len(list_intersect(t.words, l.w))::DOUBLE / len(t.words) AS c FROM l JOIN t USING (width) WHERE len(list_intersect(t.words, l.w)) >= t.need),
more AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(c) AS best FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(base.n, 0) AS n_base, base.lo AS first_word, base.hi AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
s AS (SELECT doc_id, sh, log2(1 + count(*)) AS x FROM o GROUP BY ALL),
n AS (SELECT doc_id, sum(x) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.x, b.x)) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= (0.8 - 1e-9) * (x.n + y.n - c)),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS class_id FROM documents d LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def _op7_sql() -> str:
    templates = ", ".join(f"({i}, '{label}', {words!r}, {need}, {width})" for i, label, words, need, width in template_sets())
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in PHRASES.items())
    return OP7_SQL.format(templates=templates, phrases=phrases, upper=UPPER, lower=LOWER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_multi_index_hashing": op1_multi_index_hashing,
        "op2_line_windows": op2_line_windows,
        "op3_compact_windows": op3_compact_windows,
        "op4_sainte_lague": op4_sainte_lague,
        "op5_template_windows": op5_template_windows,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_license_join": op7_license_join,
        "op8_gated_network": op8_gated_network,
        "op9_dartminhash": op9_dartminhash,
        "op10_boosted_trees": op10_boosted_trees,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_windows": OP2_SQL,
        "op4_sainte_lague": OP4_SQL,
        "op6_suffix_dedup": OP6_SQL,
        "op7_license_join": _op7_sql(),
        "op9_dartminhash": OP9_SQL.format(upper=UPPER, lower=LOWER),
    }
