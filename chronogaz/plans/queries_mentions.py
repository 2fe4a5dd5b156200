"""Mentions of names of any length in texts: dictionary, whole words, choice, first ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogaz.operators import mentions as M
from chronogaz.plans import views as V
from chronogaz.plans.registry import query

_L = M.LETTERS
_SMALL = ", ".join(f"'{c}'" for c in M.CONNECTORS)
_LANDS = ", ".join(f"'{c.lower()}'" for c in M.COUNTRIES)
_CLOSE, _OPEN = """["”’''\\)\\]}]*""", """["“‘\\(\\[{]*"""
_VARIANTS = f""", vn AS (SELECT DISTINCT place, name, unnest(CASE WHEN contains(name, ' ') AND lower(split_part(name, ' ', 1)) IN ({_SMALL}) THEN [name, upper(substr(name, 1, 1)) || substr(name, 2), lower(substr(name, 1, 1)) || substr(name, 2)] ELSE [name] END) AS v FROM v_place_name),
ev AS (SELECT DISTINCT place, v AS name, lower(trim(v)) AS norm FROM vn),
di AS (SELECT DISTINCT place, v AS name, lower(trim(v)) AS norm FROM vn WHERE len(list_filter(regexp_extract_all(name, '[A-Za-zÀ-ÖØ-öø-ÿ]+'), lambda w: w = lower(w) AND lower(w) NOT IN ({_SMALL}))) = 0 AND lower(trim(v)) NOT IN ({_LANDS})),
sp AS (SELECT place, name, norm FROM di JOIN (SELECT norm FROM di GROUP BY 1 HAVING count(DISTINCT place) = 1) USING (norm))"""


@query(_VARIANTS + " SELECT place, name, norm FROM sp", ("v_place_name",))
def txt6_mention_dictionary(spark, sf):
    """Names, as they may stand in a text, of exactly one place; no country's, and no lower-case word in them but connectors."""
    return M.dictionary(V.v_place_name(spark, sf).select("place", "name"))


def _grams(src: str, key: str) -> str:
    """Runs of up to six words (src: key, pos, gap, word) that open as a name does: key, pos, n, name."""
    leads = ", ".join(f"lead(gap || word, {i}) OVER w AS e{i}" for i in range(1, 6))
    runs = ", ".join("{'n': %d, 'name': %s}" % (n, " || ".join(["word", *[f"e{i}" for i in range(1, n)]])) for n in range(1, 7))
    return f"(SELECT {key}, pos, g.n AS n, g.name AS name FROM (SELECT {key}, pos, unnest([{runs}]) AS g FROM (SELECT *, {leads} FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY pos)) WHERE word IN (SELECT regexp_extract(name, '^[{_L}]+') FROM ev)) WHERE g.name IS NOT NULL)"


_HITS = (
    _VARIANTS
    + f""", st AS (SELECT doc_id, place AS own, regexp_extract_all(text, '[^{_L}]*[{_L}]+') AS p FROM v_story),
tk AS (SELECT doc_id, pos, regexp_extract(x, '^[^{_L}]*') AS raw, regexp_extract(x, '[{_L}]+$') AS word FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS pos FROM st)),
tc AS (SELECT *, regexp_replace(raw, '\\s+', ' ', 'g') AS gap, substr(word, 1, 1) <> lower(substr(word, 1, 1)) AS cap, raw NOT IN ('''', '’') AS head, regexp_matches(raw, '[.!?]{_CLOSE}\\s*$') OR pos = 1 AND regexp_matches(raw, '^{_CLOSE}\\s*$') AS opens FROM tk),
th AS (SELECT *, last_value(CASE WHEN head THEN cap END IGNORE NULLS) OVER w AS head_cap, last_value(CASE WHEN head THEN opens END IGNORE NULLS) OVER w AS head_starts FROM tc WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
hi AS (SELECT g.* FROM {_grams('th', 'doc_id')} g WHERE name IN (SELECT name FROM ev)),
mi AS (SELECT doc_id, pos AS b, max_by(n, length(name)) AS n FROM (SELECT DISTINCT h.doc_id, pos, n, h.name FROM hi h JOIN st USING (doc_id) JOIN ev ON ev.place = own AND ev.name = h.name) GROUP BY 1, 2),
ma AS (SELECT doc_id, list_reduce(list([{{'b': b, 'n': n}}] ORDER BY b), lambda acc, x: CASE WHEN x[1].b >= acc[-1].b + acc[-1].n THEN acc || x ELSE acc END) AS masks FROM mi GROUP BY 1),
nx AS (SELECT nm, unnest(p) AS x, generate_subscripts(p, 1) AS pos FROM (SELECT DISTINCT ev.name AS nm, regexp_extract_all(ev.name, '[^{_L}]*[{_L}]+') AS p FROM ev JOIN st ON own = place)),
ns AS (SELECT nm, pos, regexp_extract(x, '^[^{_L}]*') AS gap, regexp_extract(x, '[{_L}]+$') AS word FROM nx),
bk AS (SELECT DISTINCT e.place AS own, sp.norm FROM {_grams('ns', 'nm')} g JOIN sp ON sp.name = g.name JOIN ev e ON e.name = nm),
cd AS (SELECT h.doc_id, sp.place, h.pos, h.n, h.name, own FROM hi h JOIN sp ON sp.name = h.name JOIN st USING (doc_id) WHERE sp.place <> own AND NOT EXISTS (SELECT 1 FROM bk WHERE bk.own = st.own AND bk.norm = sp.norm)),
me AS (SELECT c.doc_id, c.place, c.pos, c.n, c.name FROM cd c LEFT JOIN ma USING (doc_id) LEFT JOIN th t0 ON t0.doc_id = c.doc_id AND t0.pos = c.pos - 1 JOIN th t1 ON t1.doc_id = c.doc_id AND t1.pos = c.pos LEFT JOIN th t2 ON t2.doc_id = c.doc_id AND t2.pos = c.pos + c.n LEFT JOIN th t3 ON t3.doc_id = c.doc_id AND t3.pos = c.pos + c.n + 1
  WHERE len(list_filter(coalesce(masks, []), lambda m: m.b < c.pos + c.n AND c.pos < m.b + m.n)) = 0
  AND NOT coalesce(regexp_matches(t1.raw, '^[.{_CLOSE[1:]}[ -]$') AND t0.head_cap AND NOT t0.head_starts, false) AND NOT coalesce(regexp_matches(t2.raw, '^[ -]{_OPEN}$') AND t2.cap, false) AND NOT coalesce(t2.raw = ' ' AND t2.word = 'of' AND t3.raw = ' ' AND t3.cap, false))"""
)


def _mentions(spark, sf):
    story = V.v_story(spark, sf)
    return M.mentions(story.select("doc_id", "text"), story.select("doc_id", "place"), V.v_place_name(spark, sf).select("place", "name"), "doc_id", "text")


@query(_HITS + " SELECT doc_id, place, pos::BIGINT AS pos, n::BIGINT AS n, name FROM me", ("v_place_name", "v_story"))
def txt7_whole_word_mentions(spark, sf):
    """Whole-word mentions of names of any length, without a text's own names and parts of longer names."""
    return _mentions(spark, sf).select("doc_id", "place", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"), "name")


@query(_HITS + """, fo AS (SELECT doc_id, list_reduce(list([{'pos': pos, 'long': -length(name), 'place': place, 'n': n}] ORDER BY pos, -length(name), place, n), lambda acc, x: CASE WHEN x[1].pos >= acc[-1].pos + acc[-1].n AND NOT list_contains(list_transform(acc, lambda y: y.place), x[1].place) THEN acc || x ELSE acc END) AS m FROM me GROUP BY 1)
SELECT doc_id, c.place AS place, c.pos::BIGINT AS pos, c.n::BIGINT AS n FROM (SELECT doc_id, unnest(m) AS c FROM fo)""", ("v_place_name", "v_story"))
def txt8_chosen_mentions(spark, sf):
    """One mention for each place of a text, in order, the longer first, none overlapping."""
    return M.chosen(_mentions(spark, sf), "doc_id").select("doc_id", "place", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"))


@query(_HITS + " SELECT doc_id, place, min(pos)::BIGINT AS pos FROM me GROUP BY 1, 2", ("v_place_name", "v_story"))
def win18_first_mentions(spark, sf):
    """The first mention of each place in a text."""
    return _mentions(spark, sf).groupBy("doc_id", "place").agg(F.min("pos").cast("long").alias("pos"))
