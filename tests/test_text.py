"""Texts, names and similarity on small literal rows."""

import pytest
from pyspark.sql import functions as F

from casegraph.functions import text as X
from casegraph.operators import entities as E


def one(spark, make, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("r")).first()["r"]


NUMBERS = [
    ("SOU 2024:55", "SOU 2024:55"), ("SOU 2024-55", "SOU 2024:55"), ("SOU2024:55", "SOU 2024:55"), ("sou-2024-55", "SOU 2024:55"), ("Dir 2023:171", "Dir. 2023:171"),
    ("Dir. 2023-171", "Dir. 2023:171"), ("Prop. 2024/25:1", "Prop. 2024/25:1"), ("Ds 2025:1", "Ds 2025:1"), ("U2025/02147", "U2025/02147"), ("Ju2025/00680 Sekretess och", "Ju2025/00680"),
    ("2024/25:FPM12", "2024/25:FPM12"), ("Bet. 2024/25:FiU21", "HC01FiU21"), ("vanlig text", None), ("SOU&nbsp;2024:55", "SOU 2024:55"),
]


def test_document_numbers(spark):
    df = spark.createDataFrame(NUMBERS, "raw string, expected string")
    rows = df.select("raw", "expected", X.document_number(F.col("raw"))["number"].alias("got")).collect()
    assert [(r["raw"], r["got"]) for r in rows] == [(r["raw"], r["expected"]) for r in rows]


def test_entities_keep_their_case(spark):
    assert one(spark, X.decode_entities, "f&ouml;r &Ouml;st &amp;ouml; &#229; &ndash;") == "för Öst ö å –"


@pytest.mark.parametrize(("text", "date", "precision"), [("den 7 april 2025", "2025-04-07", "day"), ("7 april 2025", "2025-04-07", "day"), ("Stockholm i april 2025", "2025-04-01", "month"), ("2024-02-29", "2024-02-29", "day"), ("31 februari 2024", None, None), ("inget", None, None)])
def test_dates(spark, text, date, precision):
    got = one(spark, X.swedish_date, text)
    if date is None:
        assert got is None or got["precision"] == "month"
    else:
        assert (str(got["date"]), got["precision"]) == (date, precision)


def test_links(spark):
    cases = [
        ("https://www.regeringen.se/rattsliga-dokument/kommittedirektiv/2023/12/dir.-2023171", "Direktivet", "cites", False),
        ("https://www.regeringen.se/x", "Ändringar i lagen", "amends", False), ("https://www.regeringen.se/x", "Remissvar på förslaget", "responds_to", False),
        ("https://www.regeringen.se/pressmeddelanden/2024/x", "Direktiv", "related", True), ("https://example.com/a", "x", "related", True),
    ]
    df = spark.createDataFrame(cases, "url string, anchor string, kind string, external boolean")
    got = df.select("kind", F.col("external").alias("e"), *(c.alias(n) for n, c in X.link_kind(F.col("url"), F.col("anchor")).items())).collect()
    assert [(r["reference_type"], r["external"]) for r in got] == [(r["kind"], r["e"]) for r in got]


def test_sanitize_and_stats(spark):
    assert one(spark, X.sanitize, " a\r\nb\rc\n\n\n\n\nd\0é ") == "a\nb\nc\n\n\ndé"
    df = spark.createDataFrame([("a b\n\nc",), ("",), (None,)], "t string")
    rows = df.select(*(c.alias(n) for n, c in X.text_stats(F.col("t")).items())).collect()
    assert [tuple(r) for r in rows] == [(6, 3, 3, 2), (0, 0, 0, 0), (0, 0, 0, 0)]


@pytest.mark.parametrize(("a", "b", "lo", "hi"), [("Dals Eds kommun", "Dals-Eds kommun", 1, 1), ("TERACOM", "teracom", 1, 1), ("Teracom", "Teracom AB", 0.8, 1), ("kommunal", "nätverket för kommunala lärcentra", 0, 0.699), ("A-B-C", "A B C", 1, 1), ("", "x", 0, 0)])
def test_similarity(spark, a, b, lo, hi):
    assert lo <= one(spark, E.similarity, a, b) <= hi


ORGS = [
    ("Nitus", "Nitus"), ("Riksarkivets", "Riksarkivet"), ("Teracom.pdf", "Teracom"), ("Riksdagens ombudsmän (JO) (pdf 140 kB)", "Riksdagens ombudsmän"), ("Blekinge Tekniska Högskola.PDF", "Blekinge Tekniska Högskola"),
    ("Bilaga Östhammars kommun", "Östhammars kommun"), ("Remiss av betänkande SOU 2025:103", ""), ("Teracom AB", "Teracom"), ("Vinnovas", "Vinnova"), ("Trafikanalys", "Trafikanalys"),
    ("AP  fonden", "AP-fonden"), ("Patent och registreringsverket", "Patent- och registreringsverket"), ("info@x.se", ""),
]


def test_organisation_names(spark):
    df = spark.createDataFrame(ORGS, "raw string, expected string")
    rows = df.select("raw", "expected", E.normalize_org(F.col("raw")).alias("got")).collect()
    assert [(r["raw"], r["got"]) for r in rows] == [(r["raw"], r["expected"]) for r in rows]


def test_cascade(spark):
    entities = spark.createDataFrame([("1", "Sveriges Kommuner och Regioner"), ("2", "Naturvårdsverket (NVV)"), ("3", "Svenska Bioenergiföreningen"), ("4", "Helsingborgs kommun"), ("5", "Riksarkivet")], "entity_id string, entity_name string")
    names = spark.createDataFrame([(n,) for n in ("riksarkivet", "SKR", "NVV", "XYZ", "Svensk Bioenergi", "Helsingborgs stad", "Något helt annat")], "name string")
    got = {r["name"]: (r["entity_id"], r["confidence"], r["method"]) for r in E.resolve(names, entities).collect()}
    assert got["riksarkivet"] == ("5", "high", "exact")
    assert got["SKR"] == ("1", "high", "abbreviation") and got["NVV"] == ("2", "high", "abbreviation")
    assert got["XYZ"] == (None, "low", "abbreviation")
    assert got["Helsingborgs stad"][:2] == ("4", "high")
    assert got["Något helt annat"][1] == "unmatched" and len(got) == 7
