"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogaz.llm import (
    decontaminate,
    fill_middle,
    html_extraction,
    language_id,
    lexical_search,
    license_scan,
    media_columns,
    sharding,
    simhash_dedup,
    source_mix,
    suffix_dedup,
    token_output,
    toxicity,
)
from chronogaz.llm.common import crc_mod, table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_digest(table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = docs.select("doc_id", "source", source_mix.word_count(F.col("text")).alias("size"))
    return source_mix.mix(rows, F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.where(~F.col("held_out")).select("doc_id", "text"), labels)
    return toxicity.score(docs, model, extra=("held_out",))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fim_digest(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_media_columns,
        op3_token_output,
        op4_decontamination,
        op5_language_id,
        op6_source_mix,
        op7_license_scan,
        op8_simhash,
        op9_toxicity,
        op10_html_extraction,
        op11_sharding,
        op12_fill_middle,
        op13_lexical_search,
    )
}

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
ORACLE_SQL = {
    "op4_decontamination": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), wins AS (
  SELECT r, coalesce(item_id::VARCHAR, '') AS item, i AS j, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT *, row_number() OVER () AS r FROM bw), LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i) WHERE len(ws) > 0
), places AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM w, (SELECT DISTINCT n FROM wins), LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i) WHERE len(ws) >= n
), hits AS (
  SELECT p.doc_id, p.i, p.n, x.item, x.r, x.j FROM places p JOIN wins x USING (n, win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
), verbatim AS (
  SELECT doc_id, item, min(i) - 1 AS place, n + count(*) - 1 AS size
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, r, n, i - j ORDER BY i) AS g FROM hits) GROUP BY doc_id, item, r, n, i - j, g
), longest AS (
  SELECT * FROM verbatim QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, place, item) = 1
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest.size, 0)::BIGINT AS longest_match,
       longest.place AS longest_at, longest.item AS longest_item
FROM w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) LEFT JOIN longest USING (doc_id)""",
    "op6_source_mix": f"""
WITH d AS (SELECT doc_id, source, {_SIZE}::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3e0, 1e0, 2e0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
b AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5e0 - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2e0 AS budget,
    (sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS weight_left,
    row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS rank FROM r
),
f AS (SELECT min(rank) AS rank FROM b WHERE NOT (source_size * 2e0 * weight_left <= budget * weight)),
t AS (
  SELECT b.source, b.source_size, CASE WHEN f.rank IS NULL OR b.rank < f.rank THEN b.source_size * 2e0 ELSE x.budget * b.weight / x.weight_left END AS target
  FROM b CROSS JOIN f LEFT JOIN b x ON x.rank = f.rank
),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken FROM p""",
    "op11_sharding": r"""
WITH RECURSIVE bits AS (
  SELECT 0 AS k, i, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT k + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
raw AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
d AS (
  SELECT doc_id, size::BIGINT AS size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM raw, crc
), r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no FROM d),
total AS (SELECT count(*) AS n FROM d),
root AS (SELECT n, CASE WHEN n < 2 THEN 1 ELSE ceil(sqrt(n::DOUBLE))::BIGINT END AS q FROM total),
ab AS (SELECT n, a, (n + a - 1) // a AS b FROM root, LATERAL (SELECT unnest(range(q, greatest(q + 1, 2 * q))) AS a) ORDER BY (a - n % a) % a, a LIMIT 1),
walk AS (
  SELECT row_no, 0 AS k, row_no // b AS l, row_no % b AS r, n, a, b FROM r, ab
  UNION ALL
  SELECT row_no, CASE WHEN k < 6 THEN k + 1 ELSE 0 END,
    CASE WHEN k = 6 THEN l WHEN k % 2 = 0 THEN (l + ('0x' || substr(md5('shard-1:' || k || ':' || r), 1, 15))::BIGINT % a) % a ELSE l END,
    CASE WHEN k = 6 THEN r WHEN k % 2 = 1 THEN (r + ('0x' || substr(md5('shard-1:' || k || ':' || l), 1, 15))::BIGINT % b) % b ELSE r END, n, a, b
  FROM walk WHERE k < 6 OR l * b + r >= n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((l * b + w.r) % 8)::INT AS shard, (l * b + w.r) // 8 AS slot, NULL::INT AS grown_shard, row_no
FROM r JOIN walk w USING (row_no) WHERE w.k = 6 AND l * b + w.r < n""",
    "op12_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:n], '') AS suffix FROM k
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""",
    "op13_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), q AS (
  SELECT r, item_id, unnest(list_distinct(ws)) AS term
  FROM (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
), size AS (SELECT count(*)::BIGINT AS n, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(ws) * n) // total) AS m FROM d, size WHERE len(ws) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
scores AS (
  SELECT q.r, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m ON m.r = tf.r GROUP BY q.r, item_id, doc_id, m.r
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10""",
}
