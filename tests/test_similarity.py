"""The fast Ratcliff-Obershelp ratio equals difflib exactly (property test + a classification check)."""

from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.operators.classify import ratio

ALPHABET = "abcde fgh#1"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=300), st.text(alphabet=ALPHABET, max_size=40))
def test_ratio_equals_difflib(a, b):
    assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_long_b_defers_to_difflib():
    a, b = "x" * 50 + "abc" * 100, "abc" * 80
    assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_normalisation_rules(spark):
    from fleetlens.functions.columns import normalize_text

    # only the literal chunks '.,;:', '!?' and the two quotes together are removed
    rows = spark.createDataFrame([('  Falla.,;:  de  Motor!? "\'x ',), ("a. b",)], "t string")
    assert [r[0] for r in rows.select(normalize_text("t")).collect()] == ["falla de motor x", "a. b"]


def test_classification_ties_and_keywords(spark):
    from fleetlens.operators import classify as C

    tax = spark.createDataFrame([
        ("t1", "frenos", "disco", 1, "frenos disco"), ("t2", "frenos", "disco", 2, "frenos disco"),
        ("t3", "motor", "bomba", 3, "motor bomba")],
        "taxonomia_id string, sistema string, componente string, id_modo_falla long, descripcion_estandar string")
    modes = spark.createDataFrame([(1, "m1", "ruido, freno"), (2, "m2", "ruido,freno"), (3, "m3", "")],
                                  "id_modo_falla long, modo string, palabras_claves string")
    cat = C.catalogue(tax, modes)
    assert sorted(r["taxonomia_id"] for r in cat.collect()) == ["t1", "t2"]  # mode without keywords skipped
    orders = spark.createDataFrame([("o1", "Ruido en el FRENO."), ("o2", "palabra compuesta")],
                                   "ot_id string, descripcion_falla string")
    out = {r["ot_id"]: r for r in C.classify(orders, cat).collect()}
    # t1 and t2 tie exactly: the first in (system, component, mode) order wins
    assert out["o1"]["taxonomia_id"] == "t1"
    # only the literal substring '.,;:' is stripped, so "freno." keeps its period: 1 of 2 keywords match
    exp = 0.5 * 0.5 + 0.3 * SequenceMatcher(None, "ruido en el freno.", "frenos disco").ratio()
    assert abs(out["o1"]["confianza"] - exp) < 1e-12


def test_catalogue_of_any_size(spark):
    """More catalogue rows than a block or any former cap: every candidate is scored and the best one wins."""
    from pyspark.sql import functions as F

    from fleetlens.operators import classify as C

    tax = spark.range(20_100).select(F.format_string("t%05d", "id").alias("taxonomia_id"), F.lit("motor").alias("sistema"),
                                     F.format_string("c%05d", "id").alias("componente"), F.lit(1).cast("long").alias("id_modo_falla"),
                                     F.format_string("motor c%05d", "id").alias("descripcion_estandar"))
    modes = spark.createDataFrame([(1, "m1", "ruido")], "id_modo_falla long, modo string, palabras_claves string")
    orders = spark.createDataFrame([("o1", "motor c20077")], "ot_id string, descripcion_falla string")
    cat = C.catalogue(tax, modes)
    scored = C.candidates(orders, cat)
    assert scored.count() == 20_100
    best = C.classify(orders, cat, scored=scored).first()
    assert best["taxonomia_id"] == "t20077" and abs(best["confianza"] - 0.3) < 1e-12
