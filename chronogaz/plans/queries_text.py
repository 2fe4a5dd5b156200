"""Text queries: folds, ranked search, mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogaz.functions import normal
from chronogaz.functions import text as X
from chronogaz.operators import textjobs as J
from chronogaz.plans import views as V
from chronogaz.plans.registry import query

_NAMES = "SELECT DISTINCT p_name AS name FROM part UNION SELECT n_name FROM nation"
_QUERIES = ("red", "steel", "brazl", "ste", "german", "pmall")


def _names(spark, sf):
    return V.read(spark, sf, "part").select(F.col("p_name").alias("name")).unionByName(V.read(spark, sf, "nation").select(F.col("n_name").alias("name"))).distinct()


@query("SELECT doc_id, lower(strip_accents(coalesce(text, ''))) AS folded FROM documents")
def str1_accent_fold(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", normal.folded(F.coalesce("text", F.lit(""))).alias("folded"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type || '--' || p_name), '[^a-z0-9]+', ' ', 'g')) AS folded FROM part")
def str2_ascii_fold(spark, sf):
    return V.read(spark, sf, "part").select("p_partkey", X.ascii_fold(F.concat("p_type", F.lit("--"), "p_name")).alias("folded"))


_LOW = f"SELECT name, lower(strip_accents(name)) AS f FROM ({_NAMES})"
_Q = " UNION ALL ".join(f"SELECT '{q}' AS q" for q in _QUERIES)


@query(f"""SELECT q, name, rank::BIGINT AS rank, pos::BIGINT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, pref, f, name) AS pos FROM (
SELECT q, name, f, CASE WHEN f = q THEN 0 WHEN starts_with(f, q) THEN 1 WHEN contains(f, ' ' || q) THEN 1 WHEN length(q) >= 5 AND list_bool_or(list_transform(string_split(f, ' '), lambda x: levenshtein(x, q) <= 1)) THEN 2 END AS rank,
CASE WHEN starts_with(f, q) THEN 0 ELSE 1 END AS pref FROM ({_LOW}), ({_Q})) WHERE rank IS NOT NULL) WHERE pos <= 8""")
def txt1_ranked_search(spark, sf):
    return J.ranked_search(_names(spark, sf), _QUERIES, 8).select("q", "name", "rank", "pos")


_SEARCHED = "SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name || ' E' || chr(769) || 'vora' FROM supplier)"
_ASKED = "SELECT DISTINCT q FROM (SELECT split_part(p_name, ' ', 2) AS q FROM part UNION ALL SELECT substr(n_name, 1, 3) FROM nation UNION ALL SELECT substr(n_name, 1, 2) || substr(n_name, 4) FROM nation UNION ALL SELECT replace(s_name, 'l', 'p') FROM supplier UNION ALL SELECT replace(n_name, 'A', 'Ä') || ' ' FROM nation UNION ALL SELECT 'évo')"


def _one_edit(a, b):
    return f"(levenshtein({a}, {b}) <= 1 OR CASE WHEN length({a}) = length({b}) THEN hamming({a}, {b}) = 2 AND list_sort(string_split({a}, '')) = list_sort(string_split({b}, '')) ELSE false END)"


@query(f"""WITH n AS (SELECT name, lower(strip_accents(name)) AS f FROM ({_SEARCHED})), q AS (SELECT q, lower(strip_accents(trim(q))) AS fq FROM ({_ASKED})),
nw AS (SELECT *, regexp_extract_all(f, '[\\p{{L}}\\p{{N}}]+') AS ws, regexp_replace(f, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS fl FROM n), ql AS (SELECT *, regexp_replace(fq, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS l FROM q),
r AS (SELECT q, name, f, CASE WHEN f = fq THEN 0 WHEN starts_with(f, fq) THEN 2 WHEN list_bool_or(list_transform(ws, lambda x: starts_with(x, fq))) THEN 3
WHEN length(l) >= 5 AND list_bool_or(list_transform(list_filter(list_append(ws, fl), lambda x: length(x) >= 5), lambda x: {_one_edit('l', 'x')})) THEN 4 END AS r FROM nw, ql)
SELECT q, name, (r // 2)::BIGINT AS rank, row_number() OVER (PARTITION BY q ORDER BY r, f, name)::BIGINT AS pos FROM r WHERE r IS NOT NULL QUALIFY pos <= 8""")
def txt1_search(spark, sf):
    """Searches from tables, a typo of each supplier and nation among them, over the names of all tables; some names and
    searches have accents, written apart and in one letter."""
    t = lambda name, c: V.read(spark, sf, name).select(c)
    n = F.col("n_name")
    names = t("part", F.col("p_name").alias("name")).unionByName(t("nation", n.alias("name"))).unionByName(t("customer", F.col("c_name").alias("name")))
    names = names.unionByName(t("supplier", F.concat("s_name", F.lit(" E\u0301vora")).alias("name")))
    asked = [t("part", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("q")), t("nation", F.substring(n, 1, 3).alias("q")), t("nation", F.concat(F.substring(n, 1, 2), F.substr(n, F.lit(4))).alias("q"))]
    asked += [t("supplier", F.replace("s_name", F.lit("l"), F.lit("p")).alias("q")), t("nation", F.concat(F.replace(n, F.lit("A"), F.lit("Ä")), F.lit(" ")).alias("q")), spark.sql("select 'évo' as q")]
    queries = asked[0]
    for more in asked[1:]:
        queries = queries.unionByName(more)
    return J.search(names, queries, 8)


@query("""SELECT doc_id, md5(nfc_normalize(apart)) AS composed, strlen(apart)::BIGINT AS n_apart, strlen(nfc_normalize(apart))::BIGINT AS n_bytes FROM (
SELECT doc_id, replace(replace(coalesce(text, ''), 'e ', 'e' || chr(769) || ' '), 'ac', 'a' || chr(776) || chr(803) || 'c') AS apart FROM documents)""")
def str3_composed_texts(spark, sf):
    """Whole texts in their composed form, after some of their letters got marks behind them, not all in canonical order."""
    apart = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("e "), F.lit("e\u0301 ")), F.lit("ac"), F.lit("a\u0308\u0323c"))
    d = V.read(spark, sf, "documents").select("doc_id", apart.alias("apart")).withColumn("c", normal.nfc(F.col("apart")))
    return d.select("doc_id", F.md5(F.encode("c", "UTF-8")).alias("composed"), F.octet_length("apart").cast("long").alias("n_apart"), F.octet_length("c").cast("long").alias("n_bytes"))
