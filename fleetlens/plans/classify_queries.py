"""C*: failure classification queries. The keyword part has a DuckDB oracle; the similarity
(an Arrow UDF, no SQL twin) makes the full classification rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from ..session import stored
from ..sources.fixtures import fleet
from .registry import register


def cat_frame(spark, d):
    f = fleet(spark, d)
    return C.catalogue(f.taxonomia_fallas, f.modo_falla)


_SCORED: dict[tuple, object] = {}


def _once(spark, d, name, make):
    """Rows that several queries read, stored once per session and input."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _SCORED:
        _SCORED[key] = stored(make())
    return _SCORED[key]


FULL, TEXT, WORDS = (0.50, 0.30, 0.10, 0.10), (0.60, 0.40, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0)


def scored(spark, d, weights=FULL):
    """All candidates of all descriptions."""
    return _once(spark, d, ("all", weights), lambda: C.candidates(fleet(spark, d).descripciones, cat_frame(spark, d), weights))


def best(spark, d, weights=FULL):
    return _once(spark, d, ("best", weights), lambda: C.best_candidates(fleet(spark, d).descripciones, cat_frame(spark, d), weights))


def classified(spark, d, weights=FULL):
    return C.classify(fleet(spark, d).descripciones, cat_frame(spark, d), weights, scored=best(spark, d, weights))


NORM = """trim(regexp_replace(replace(replace(replace(lower(coalesce(descripcion_falla, '')), '.,;:', ''), '!?', ''), '"''', ''),
  '\\s+', ' ', 'g'))"""


@register("C1_keyword_candidates", f"""
WITH cat AS (
  SELECT t.taxonomia_id, list_distinct(list_filter(list_transform(string_split(lower(coalesce(m.palabras_claves, '')), ','),
           lambda x: trim(x)), lambda x: x <> '')) AS kw
  FROM taxonomia_fallas t LEFT JOIN modo_falla m ON t.id_modo_falla = m.id_modo_falla),
cat2 AS (SELECT * FROM cat WHERE len(kw) > 0),
kws AS (SELECT taxonomia_id, len(kw) AS n_kw, unnest(kw) AS w FROM cat2),
o AS (SELECT ot_id, {NORM} AS d FROM descripciones),
words AS (SELECT DISTINCT ot_id, unnest(string_split(d, ' ')) AS w FROM o)
SELECT words.ot_id, kws.taxonomia_id, count(*) AS n_hit, round(count(*) / any_value(kws.n_kw), 12) AS score_palabras
FROM words JOIN kws ON words.w = kws.w GROUP BY words.ot_id, kws.taxonomia_id""")
def c1k(spark, d):
    return C.keyword_candidates(fleet(spark, d).descripciones, cat_frame(spark, d))


@register("C1_classify_documents")
def c1(spark, d):
    return classified(spark, d)


@register("C2_classify_documents_60_40")
def c2(spark, d):
    return classified(spark, d, TEXT)


@register("C4_routed_events")
def c4a(spark, d):
    return C.route(classified(spark, d))[0]


@register("C4_review_queue")
def c4b(spark, d):
    return C.route(classified(spark, d), scored(spark, d))[1]


def reviewed(spark, d, weights=FULL):
    """Manual outcome from the labels table: quality = 1 accepts the best row of the review queue."""
    events, review = C.route(classified(spark, d, weights))
    accepted = fleet(spark, d).raw("labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("ot_id"))
    decisions = review.filter(F.col("mejor").isNotNull()).select("ot_id", F.col("mejor").alias("taxonomia_id")).join(accepted, "ot_id", "left_semi")
    return C.apply_review(events, decisions)


@register("C5_apply_review")
def c5(spark, d):
    return reviewed(spark, d)


# the similarity has no SQL twin: with its weight at 0 the same path, from search to review, has one
WORDS_SQL = f"""
cat AS (
  SELECT t.*, m.modo, list_distinct(list_filter(list_transform(string_split(lower(coalesce(m.palabras_claves, '')), ','),
           lambda x: trim(x)), lambda x: x <> '')) AS kw
  FROM taxonomia_fallas t LEFT JOIN modo_falla m ON t.id_modo_falla = m.id_modo_falla),
hit AS (
  SELECT o.ot_id, c.taxonomia_id, c.sistema, c.componente, c.id_modo_falla, c.modo, len(c.kw) AS n_kw, list_sort(list(DISTINCT o.w)) AS hw
  FROM (SELECT ot_id, unnest(string_split({NORM}, ' ')) AS w FROM descripciones) o
  JOIN (SELECT *, unnest(kw) AS w FROM cat) c ON o.w = c.w GROUP BY ALL),
top AS (SELECT *, len(hw) / n_kw AS score FROM hit
  QUALIFY row_number() OVER (PARTITION BY ot_id ORDER BY len(hw) / n_kw DESC, sistema, componente, id_modo_falla, taxonomia_id) = 1),
cls AS (
  SELECT d.ot_id, taxonomia_id, sistema, componente, modo, coalesce(round(score, 12), 0.0) AS confianza,
    CASE WHEN score IS NULL THEN 'Sin coincidencias en taxonomía'
         ELSE 'Clasificado automático (score: ' || printf('%.2f', score) || ', palabras: ' || array_to_string(hw[1:3], ', ') || ')' END AS motivo
  FROM descripciones d LEFT JOIN top ON d.ot_id = top.ot_id)"""


@register("C1_classify_by_keywords", f"WITH {WORDS_SQL} SELECT * FROM cls")
def c1w(spark, d):
    return classified(spark, d, WORDS)


@register("C4_routed_events_by_keywords", f"""
WITH {WORDS_SQL} SELECT ot_id, taxonomia_id, confianza, 'automático' AS fuente FROM cls WHERE confianza >= 0.5 AND taxonomia_id IS NOT NULL""")
def c4w(spark, d):
    return C.route(classified(spark, d, WORDS))[0]


@register("C5_apply_review_by_keywords", f"""
WITH {WORDS_SQL}, auto AS (SELECT * FROM cls WHERE confianza >= 0.5 AND taxonomia_id IS NOT NULL)
SELECT ot_id, taxonomia_id, confianza, 'automático' AS fuente FROM auto
UNION ALL SELECT ot_id, taxonomia_id, 1.0, 'manual' FROM cls
WHERE taxonomia_id IS NOT NULL AND ot_id NOT IN (SELECT ot_id FROM auto)
  AND ot_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)""")
def c5w(spark, d):
    return reviewed(spark, d, WORDS)


@register("C3_best_of_bounded_search", """
SELECT ot_id, TRUE AS igual FROM descripciones""")
def c3(spark, d):
    """The bounded search against the best of all pairs: for every description the same row and score."""
    f = fleet(spark, d)
    every = C.classify(f.descripciones, cat_frame(spark, d), scored=scored(spark, d))
    few = classified(spark, d)
    j = every.alias("a").join(few.alias("b"), "ot_id", "full")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("taxonomia_id", "confianza", "motivo")]
    return j.select("ot_id", (same[0] & same[1] & same[2]).alias("igual"))


@register("J17_unclassified_orders", """
SELECT * FROM ordenes_trabajo WHERE ot_id NOT IN (SELECT ot_id FROM ot_falla_evento WHERE ot_id IS NOT NULL)""")
def j17(spark, d):
    f = fleet(spark, d)
    return C.unclassified_orders(f.ordenes_trabajo, f.ot_falla_evento)
