import pytest

from tasklattice.llm import broken_responses as B
from tasklattice.llm import languages

PROMPT = '["Betrugsprüfung aus Verträgen mit Bildmodellen", "Routenplanung mit neuronalen Netzen"]'
GOOD = '["Einsatz von Bildmodellen für die Betrugsprüfung", "Aufbereitung von Verträgen für die Routenplanung"]'
CASES = [
    (PROMPT, GOOD, []),
    (PROMPT, "Einsatz von Bildmodellen für die Betrugsprüfung\nRoutenplanung mit neuronalen Netzen", []),
    (PROMPT, '["Routenplanung mit neuronalen Netzen"]', []),
    (PROMPT, None, ["empty"]), (PROMPT, " \n", ["empty"]), (PROMPT, "```json\n```", ["empty"]), (PROMPT, '"N/A"', ["empty"]), (PROMPT, "[]", ["empty"]), (PROMPT, '[""]', ["empty"]), (PROMPT, "null", ["empty"]),
    (PROMPT, GOOD[:70], ["truncated"]), (PROMPT, '["Einsatz von Bildmodellen für", "Einsatz von"]', ["truncated"]),
    (PROMPT, '{"ai_task": "Es tut mir leid, dabei darf ich nicht helfen."}', ["refusal"]), (PROMPT, "Ich kann Ihnen dabei leider nicht helfen.", ["refusal"]),
    (PROMPT, f"Output:\n{PROMPT.upper()}", ["copy"]), (PROMPT, f"```json\n{PROMPT}\n```", ["copy"]),
    (PROMPT, '["préparer les contrats numérisés pour le contrôle des fraudes", "utiliser des réseaux de neurones pour la planification"]', ["other_language"]),
    (PROMPT, "Подготовка договоров для проверки, планирование маршрутов с помощью сетей", ["other_language"]),
    (None, GOOD, []), ("", GOOD, []),
    # several defects at once
    (PROMPT, "[", ["empty", "truncated"]), (PROMPT, "```json\n[]", ["empty", "truncated"]),
    (PROMPT, "I'm sorry, but I cannot help with this request.", ["refusal", "other_language"]),
    ("Wir suchen Sie.\nWir bieten viel Ruhe und Zeit.", "Wir suchen Sie.\nWir bieten viel Ru", ["copy", "truncated"]),
    # tasks that can't be done by hand are no refusals
    (PROMPT, "We cannot rely on manual checks, so models inspect parts", ["other_language"]),
    (PROMPT, '["Fälle, die nicht erklärbar sind, werden gemeldet.", "Modelle beantworten Fragen der Kunden."]', []),
    # a refusal may be long and have many lines
    (PROMPT, "Leider kann ich diese Anfrage nicht bearbeiten.\n" + "\n".join(["Bitte wenden Sie sich an eine Fachperson."] * 5), ["refusal"]),
]


@pytest.fixture(scope="module")
def profiles():
    return languages.fit([])


@pytest.mark.parametrize("prompt,response,want", CASES)
def test_rules(profiles, prompt, response, want):
    assert B.defects(profiles, prompt, response) == want


def test_closed_lists_that_break_off(spark, profiles):
    full = '["Preisbildung mit lernenden Agenten", "Einsatz von Bildmodellen"]'
    rows = [(1, i, PROMPT, full.replace("Preis", f"Preis{chr(97 + i)}"), "x") for i in range(12)] + [(1, 50, PROMPT, '["Preisbildung mit lernenden Agenten", "Schichtplanung mit lernenden Age"]', None), (1, 51, PROMPT, '["Einsatz von Bildmodellen", "Schichtplanung mit lernenden"]', None), (2, 1, PROMPT, None, None), (2, 1, PROMPT, None, None)]
    df = spark.createDataFrame(rows, "step_no int, uid bigint, prompt string, response string, defect string")
    got = {tuple(r) for r in B.first(B.flagged(df, profiles)).collect()}
    assert got == {(1, 50, "truncated"), (1, 51, "truncated"), (2, 1, "empty")}
    assert B.flagged(df.limit(0), profiles).count() == 0


def test_evidence_is_a_share_not_a_count(spark, profiles):
    """One statement in a hundred that ends in a word which otherwise goes on
    doesn't make cut statements whole, and copies of a statement count once."""
    rows = [(1, i, PROMPT, f'["Fall {chr(97 + i // 26)}{chr(97 + i % 26)} mit lernenden Agenten", "Einsatz von Bildmodellen"]') for i in range(200)]
    rows += [(1, 900, PROMPT, '["Weiterbildung der Lernenden", "Einsatz von Bildmodellen"]')] * 300
    rows += [(1, 901, PROMPT, '["Einsatz von Bildmodellen", "Schichtplanung mit lernenden"]')]
    df = spark.createDataFrame(rows, "step_no int, uid bigint, prompt string, response string")
    assert {tuple(r) for r in B.first(B.flagged(df, profiles)).collect()} == {(1, 901, "truncated")}


def test_other_columns_may_clash(spark, profiles):
    df = spark.createDataFrame([(1, 1, PROMPT, "[]", "a", "b", 1)], "step_no int, uid bigint, prompt string, response string, defects string, end string, n int")
    assert [tuple(r) for r in B.flagged(df, profiles).collect()] == [(1, 1, "empty", 0)]
