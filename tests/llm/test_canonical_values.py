import random

import pytest

from tasklattice.llm import canonical_values as cv

REF = [("7512", "Bäcker", "Boulanger", "Panettiere", "Baker"), ("2512", "Softwareentwickler", "Développeur de logiciels", "Sviluppatore di software", "Software Developer"), ("2144", "Maschineningenieur", "Ingénieur en mécanique", "Ingegnere meccanico", "Mechanical Engineer"), ("0310", "Berufssoldat", "Soldat de métier", "Soldato di carriera", "Career Soldier"), ("1412", "Restaurantleiter", "Gérant de restaurant", "Gerente di ristorante", "Restaurant Manager"), ("2521", "Datenbankspezialist", "Spécialiste de bases de données", "Specialista di banche dati", "Database Specialist")]
REF_COLS = "isco_code string, title_de string, title_fr string, title_it string, title_en string"
CASES = {
    "Bäcker": "7512", "BÄCKERIN (m/w/d) 80-100%": "7512", "Baer - full time": "7512", "Bakker @ Yvorens": "7512", "SW- Developer ": "2512", "Maschinen-Ing.in": "2144",
    "Wir suchen Softwareentwicklerin für unser Team in Sankt Alvis": "2512", "Développeuse de logiciels F/H": "2512", "données de bases de Spécialiste": "2521", "Datenbankspez. , Brugglisau": "2521",
    "Restaurant Mgr - full time": "1412", "JEUNE SOLDATE DE METIER": "0310", "SW-entwickler": "2512", "Bkaer (m/f/d)": "7512", "Imker": "unmatched", "": "unmatched", "Stelle frei!": "unmatched", "Restaurant": "unmatched", "x" * 20_000: "unmatched",
}


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame(REF, REF_COLS)


def test_titles(spark, ref):
    rows = spark.createDataFrame([(str(i), t, "z") for i, t in enumerate([*CASES, None])] + [("0", "Bäcker", "again")], "uid string, title string, isco_code string")
    got = {r.row_key: r.isco_code for r in cv.map_titles(rows, "uid", "title", ref).collect()}
    assert got == {str(i): c for i, c in enumerate(CASES.values())}


def test_codes(spark, ref):
    cases = {"7512": "7512", "75-12": "7512", " 75 12\t": "7512", "7512.0": "7512", "ISCO-08 7512": "7512", "CH-ISCO-19 2144": "2144", "isco:2144": "2144", "310": "0310", "310.0": "0310", "751": "unmatched", "75": "unmatched", "9999": "unmatched", "XXXX": "unmatched", "2144 Mechanical Engineer": "2144", "Boulanger": "7512", "n/a": "unmatched"}
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "link_id bigint, isco_code string")
    assert {int(r.row_key): r.isco_code for r in cv.map_codes(rows, "link_id", "isco_code", ref).collect()} == dict(enumerate(cases.values()))


def test_code_lists(spark):
    walk = spark.createDataFrame([("1 ", "7512"), (" 2", "2144"), ("2", "2144"), ("3", "7512")], "x28_code string, isco_19 string")
    rows = spark.createDataFrame([("a", "['1','3']"), ("b", '["1", "9"]'), ("c", "{2}"), ("d", "[2.0, 1.0]"), ("e", "[]"), ("f", None), ("g", " 1 2 ")], "uid string, x28_occupations string")
    got = sorted((r.row_key, r.isco_code) for r in cv.map_code_lists(rows, "uid", "x28_occupations", walk).collect())
    assert got == [("a", "7512"), ("b", "7512"), ("b", "unmatched"), ("c", "2144"), ("d", "2144"), ("d", "7512"), ("g", "2144"), ("g", "7512")]


def test_join_loses_no_pair(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(3, 9)))
    left, right = sorted({word() for _ in range(120)}), sorted({word() for _ in range(60)})
    make = lambda name, xs: spark.createDataFrame([(x, p, *cv.sketch(p)) for x in xs for p in [cv.pairs_of_letters(x)]], f"{name} string, {cv.SET_COLUMNS}")
    got = {(r.window, r.form) for r in cv.similar_sets(make("window", left), make("form", right), 0.5).collect()}
    sets = {x: set(cv.pairs_of_letters(x)) for x in [*left, *right]}
    assert got == {(a, b) for a in left for b in right if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert got
