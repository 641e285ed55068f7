import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.functions.values import complete_phrase, normalize_value


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


CASES = [
    (X.strip_accents, {"Café Mégère": "Cafe Megere", "naïve": "naive", "Straße": "Straße", "": ""}),
    (X.normalize_section, {"Éviers & Cuves": "eviers cuves", "Straße Øst": "strasse ost", "--": "", "Łazienka": "lazienka"}),
    (X.slugify, {"Évier Opale & Co": "evier-opale-and-co", "Straße": "strasse", "a+b": "aplusb"}),
    (X.humanize_key, {"538 Longueur bras": "LONGUEUR BRAS :", "538_Longueur": "LONGUEUR :", "DEB_PRESS": "DÉBIT PRESSION :", "Diamètre": "DIAMÈTRE :", "Température": "TEMPÉRATURE :", "": ""}),
    (X.clean_value, {" 'Inox' ": "Inox", "N/A.": None, "n.d.,": None, "-": None, "«Eco»": "Eco", "Non": None, "60 cm.": "60 cm.", "...": None, "0": None, "05": "05"}),
    (X.split_values, {"60 cm\n80 cm": ["60 cm", "80 cm"], "Inox | Chrome | N/A": ["Inox", "Chrome"], "5|6": ["5|6"], "a ; b": ["a", "b"], "": []}),
    (X.has_key_value, {"a : b": True, "Bistro—Casa": False, "x — y": True, "x→y": True, "plain": False}),
    (X.is_colour_code, {"RAL 9005": True, "ral9005": True, "#FFF": True, "#FFFF": False, "Pantone 405 C": True, "rgb(1, 2, 3)": True, "inox": False}),
    (X.is_common_colour, {"Chrome Brossé": True, " NOIR ": True, "Bistro Inox Vintage": False, "weiß": True}),
    (X.text_colour_on, {"#ffffff": "#000000", "#112233": "#112233"}),
    (X.has_unit, {"60 cm": True, "5inchworm": False, "7 m³/h": True, "$5": True, "abc": False, "CHF 25": True, "3 ans": True}),
    (X.looks_like_barcode, {"3325310022366": True, "100": False, "DN50 PN16": False, "&:DCPNLA=UWWX[[:": True, "ab": False}),
    (X.looks_like_legal_notice, {"© 2024 Marque": True, "Photo credit: x": True, "Inox": False, "": False, "mot " * 30: True}),
    (X.page_keyword, {"SOMMAIRE": "toc", "Légende des symboles": "glossaire", "Data sheet": "tech", "x": None}),
    (X.url_basename, {"https://a.b/c/d.jpg?x=1#y": "d.jpg", "d.jpg": "d.jpg", "a\\b.png": "b.png"}),
    (X.safe_text, {"½ “x” → y…": '1/2 "x" -> y...', "a b​c": "a bc"}),
    (X.spec_category, {"Matière": "TECHNIQUE", "HAUTEUR": "DIMENSIONS", "Coloris": "FINITION", "xyz": "AUTRES"}),
]


@pytest.mark.parametrize("f,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_text_rule(spark, f, cases):
    assert apply(spark, f, list(cases)) == list(cases.values())


def test_split_key_value(spark):
    got = apply(spark, X.split_key_value, ["Matière : inox", "a — b", "plain", "x=1=2"])
    assert [(r["key"], r["value"], r["separator"]) for r in got] == [("Matière", "inox", ":"), ("a", "b", "—"), ("plain", "", None), ("x", "1=2", "=")]


def test_style_key(spark):
    rows = spark.createDataFrame([("longueur", "MATIÈRE :"), ("Longueur", "matiere ="), ("longueur", "Matière |"), ("longueur", "DEBIT")], "a string, b string")
    assert [r[0] for r in rows.select(X.style_key(F.col("a"), F.col("b"))).collect()] == ["LONGUEUR :", "longueur =", "longueur |", "LONGUEUR :"]


def test_wrap_words(spark):
    lines = apply(spark, lambda x: X.wrap_words(x, 30.0, 10.0), ["aa bb cc", "averylongword x", "", None])
    assert lines[0] == ["aa bb", "cc"] and lines[1] == ["averylongword", "x"] and lines[2] == []


VALUES = {"70cm": "70 cm", "60x80x30": "60 x 80 x 30", "5m²": "5 m²", "1 a 5 bar": "1 à 5 bar", "50 KHZ": "50 kHz", "1.5E+02 cm": "150 cm", "10-20cm": "10-20 cm", "2 ANS": "2 ans", "Ø22": "Ø 22", "AB1E2": "AB1E2"}


@pytest.mark.parametrize("raw", VALUES)
def test_normalize_value(raw):
    once = normalize_value(raw)
    assert once == VALUES[raw] and normalize_value(once) == once


def test_complete_phrase():
    assert complete_phrase("Robinet mitigeur pour la cuisine", 22) == "Robinet mitigeur"
    assert complete_phrase("abc,", 10) == "abc" and complete_phrase(None, 5) is None


def test_values_written_out():
    want = {"5E-3": "0.005", "1.5E-1 kg": "0.15 kg", "3e-7": "3e-7", "1.23E+05": "123000", "2.5e10": "25000000000", "1.1e-5": "0.000011", "AB1E2": "AB1E2", "1e400": "1e400", "1e21": "1e+21"}
    want |= {"70cm": "70 cm", "Ø22mm": "Ø 22 mm", "10ANS": "10 ans", "1 a 5bar": "1 à 5 bar", "85°F": "85 °F", "5dm²": "5 dm²", "100 MHZ": "100 MHz", "5 MW": "5 mW", "3 KW": "3 kw", "60x40x30": "60 x 40 x 30", "10-20cm": "10-20 cm"}
    want |= {"incrémental": "incrémental", "5mé": "5 mé", "٣cm": "٣cm", "  Inox    chrome ": "Inox chrome", "8 ANNÉES": "8 années", "5min": "5 min", "5mine": "5mine", "": ""}
    assert {k: normalize_value(k) for k in want} == want


def test_categories_written_out(spark):
    want = {"Taille": "DIMENSIONS", "Capacity": "DIMENSIONS", "Profundidad": "DIMENSIONS", "Épaisseur": "DIMENSIONS", "Spessore": "DIMENSIONS", "Dicke": "DIMENSIONS", "Encombrement": "DIMENSIONS", "Entrées axes": "DIMENSIONS", "Format": "DIMENSIONS", "Tamaño": "DIMENSIONS"}
    want |= {"Température": "TECHNIQUE", "temperature": "TECHNIQUE", "Méca": "TECHNIQUE", "Énergétique": "TECHNIQUE", "energie": "TECHNIQUE", "Cor": "FINITION", "Corps": "AUTRES", "Oberfläche": "FINITION"}
    want |= {"Duración": "GARANTIE", "Durabilité": "GARANTIE", "SAV": "GARANTIE", "Condit.": "CONDITIONNEMENT", "Nature du conditionnement": "CONDITIONNEMENT", "Poids": "AUTRES"}
    got = spark.createDataFrame([(k,) for k in want], "k string").select("k", X.spec_category(F.col("k")).alias("c")).collect()
    assert {r["k"]: r["c"] for r in got} == want


def test_headers_of_sections_written_out(spark):
    from pagewright.operators.pages import is_section_header

    want = {"POMPES D'ÉVACUATION": True, "Pompes pour eaux": True, "AUTRE POMPE 12V": True, "Apres-vente": True, "Après-vente": False, "FORMATIONS": True, "Agréé": True, "Eaux claires": True, "Groupes de surpression": True, "Accessoires": True, "Les + produits": True, "Merkmale": True, "Pompe": False, "Eaux vives": False, "Évier": False}
    got = spark.createDataFrame([(k,) for k in want], "k string").select("k", is_section_header(F.col("k")).alias("h")).collect()
    assert {r["k"]: r["h"] for r in got} == want


def test_hair_space_is_printed_as_a_blank(spark):
    assert spark.range(1).select(X.safe_text(F.lit("a b​c d"))).first()[0] == "a bc d"
