import itertools

from tasklattice.llm.structural_copies import arranged, collapsed, copies_of, structure

TEXT = "Wir suchen Sie. Große Aufgabe!\nArbeitsort: Yvorens\nPensum: 80-100%\nEintritt: 01.02.2020"
SWAPPED = "WIR SUCHEN SIE GROSSE AUFGABE\n\n- EINTRITT : 01.02.2020\n* Arbeitsort: Yvorens\n\nPensum:80-100 %  "
FLAT = "wir suchen sie große aufgabe pensum 80 100 eintritt 01022020 arbeitsort yvorens"
OTHER = TEXT.replace("2020", "2021")
COLS = "uid string, company_id bigint, content_clean string, bag string"


def test_structure_and_arrangement():
    body, closing = structure(TEXT)
    assert body == "wirsuchensiegrosseaufgabe" and len(closing) == 3
    assert structure(SWAPPED) == (body, closing)
    assert arranged("".join([body, *reversed(closing)]), body, closing)
    assert not arranged(body + closing[0] * 3, body, closing)


def test_copies(spark):
    rows = [("b", 1, TEXT, "x"), ("a", 1, SWAPPED, "x"), ("c", 1, FLAT, None), ("d", 1, OTHER, None), ("e", 2, TEXT, None), ("f", None, TEXT, None), ("g", 1, None, None), ("h", 1, "  \n", None), ("i", 1, "!!!", None), ("b", 1, TEXT, "x"), ("j", 3, "x" * 200_000, None), ("k", 3, "X " * 200_000, None)]
    df = spark.createDataFrame(rows, COLS)
    assert {tuple(r) for r in copies_of(df).collect()} == {("a", "b"), ("a", "c"), ("j", "k")}
    got = {r.uid: r.copies for r in collapsed(df).collect()}
    assert got == {"a": 3, "d": 1, "e": 1, "j": 2}


def test_flat_orders_without_a_structured_copy_stay_apart(spark):
    df = spark.createDataFrame([("a", 1, "text pensum 80 ort yv", ""), ("b", 1, "text ort yv pensum 80", "")], COLS)
    assert copies_of(df).count() == 0


def test_empty(spark):
    assert copies_of(spark.createDataFrame([], COLS)).count() == 0


def test_long_closing_lines_and_labels(spark):
    """Neither the length of a closing line nor the words of its label matter."""
    lines = ["Pensum: 80-100%", "Ihre künftige Ansprechperson in unserem Haus für alle weiteren Fragen zu dieser Stelle: " + "sehr " * 20 + "gerne", "Eintritt: sofort"]
    rows = [(f"u{i}", 1, "Wir suchen Sie.\n" + "\n".join(p), "") for i, p in enumerate(itertools.permutations(lines))]
    got = {tuple(r) for r in copies_of(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {("u0", f"u{i}") for i in range(1, 6)}


def test_the_end_of_the_body_may_be_seen_differently(spark):
    """The last line of the body reads like a closing line only where the line
    isn't broken before its end."""
    whole = "Wir bieten: Ruhe und Zeit\nPensum: 50%\nOrt: Yvorens\nStart: Mai"
    broken = "Wir bieten\nRuhe und Zeit\nStart: Mai\nPensum: 50%\nOrt: Yvorens"
    other = "Wir bieten\nZeit und Ruhe\nStart: Mai\nPensum: 50%\nOrt: Yvorens"
    df = spark.createDataFrame([("a", 1, whole, ""), ("b", 1, broken, ""), ("c", 1, other, "")], COLS)
    assert {tuple(r) for r in copies_of(df).collect()} == {("a", "b")}
