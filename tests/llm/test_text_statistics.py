import pytest

from tasklattice.llm.text_statistics import document_statistics, kind, not_prose, periodicity, statistics

PROSE = "Wir suchen eine Person, die gerne mit uns arbeitet. Die Stelle ist ab sofort frei und wird gut bezahlt."
CASES = {
    PROSE: "prose",
    PROSE.upper(): "prose",
    "Das ist ein kurzer Satz ohne Punkt": "prose",
    "The salary depends on what you bring and is paid in\nthirteen parts, and all of our people have the right to\nfive weeks of holidays.": "prose",
    "- Statistik\n- faire Löhne\n- Verkauf": "list",
    "1) stock control / stock control\n2) Yvorens;\n3) free parking": "list",
    "Lohnband:\nStatistik\nVerkauf / Statistik;\nYvorens\nfaire Löhne": "list",
    "a;b;c\n1;2;NA\n3;NA;NA": "table",
    "year   share   n\n2012   0.1   NA\nNA   NA   4": "table",
    "n | share\n--- | ---\nNA | 0.2\n4 | NA": "table",
    "1\t2\t3\n4\t5\t6": "table",
    "": "junk",
    "  \n ": "junk",
    "deadbeef" * 40: "junk",
    "~ ~ ~ ~ ~ ~ ~": "junk",
    "  at mod_a.fn5(0x1f)\n  at mod_b.fn6(0x2a)": "junk",
    "{{title}} {{firm}}\n{{title}} {{firm}}\n{{title}} {{firm}}": "junk",
    "stock stock stock stock sales sales stock stock sales sales stock stock": "junk",
    "V�us pr�p�s�z d� v�us-m�m� d�s �d��s": "junk",
}


@pytest.mark.parametrize("text", CASES)
def test_kinds(text):
    assert kind(text) == CASES[text]


# Items without a marker that end in full stops and hold a frequent word each.
INDENTED = "\n".join("  " * (i % 2) + x for i, x in enumerate(("Pflege der Kunden.", "Besuche mit dem Team.", "Arbeit in der Werkstatt.", "Löten und Fräsen.", "Planung für das Lager.", "Annahme der Ware.", "Fahren im Bezirk.", "Touren und Karten.")))
LENGTHS = "\n".join(f"{a} und {b} der Kunden im Bezirk.\nMit {c}." for a, b, c in (("Verkauf", "Beratung", "Team"), ("Pflege", "Besuche", "Auto"), ("Planung", "Annahme", "Plan"), ("Einkauf", "Ausgabe", "Lohn")))


def test_periods_decide():
    assert kind(INDENTED) == "list" and kind(LENGTHS) == "list"
    assert kind("\n".join(x.strip() for x in INDENTED.splitlines())) == "prose"
    assert kind("\n".join([PROSE] * 2 + ["    " + PROSE.replace("frei", "offen")] * 2 + [PROSE.replace("gern", "oft")] * 3)) == "prose"


def test_statistics():
    s = statistics("a;b\nc;d\n")
    assert s["n_lines"] == 2 and s["delimiter_alignment"] == 1 and s["n_words"] == 4
    assert set(statistics(None).values()) == {0.0}
    assert periodicity([0, 4, 0, 4, 0, 4, 0, 4]) > 0.7 and periodicity([1, 1, 1, 1]) == 0


def test_frames(spark):
    df = spark.createDataFrame([(1, PROSE, "x"), (2, None, "x"), (3, "a;b\n1;2", None), (3, "a;b\n1;2", None), (4, "wort " * 50_000, None)], "doc_id bigint, text string, doc_kind string")
    assert {tuple(r) for r in not_prose(df).collect()} == {(2, "junk"), (3, "table"), (4, "junk")}
    assert document_statistics(df.limit(0)).count() == 0
