import pytest

from tasklattice.llm import languages as L

DE = "Sie übernehmen die Planung der Arbeiten und stimmen sich eng mit dem Einkauf ab."
FR = "Vous prenez en main la planification des travaux et vous rendez compte chaque mois à la direction."
IT = "Lei segue la pianificazione dei lavori e ne parla ogni mese con la direzione della ditta."
EN = "You take over the planning of the work and report to the management every month."


@pytest.fixture(scope="module")
def profiles():
    return L.fit([("de", f"{DE}\n{DE}"), ("fr", f"{FR} {FR}"), ("it", IT), ("en", EN), ("en", DE)])


@pytest.mark.parametrize("text,want", [(DE, "de"), (FR, "fr"), (IT, "it"), (EN, "en"), (EN.upper(), "en"), (FR.replace(" ", " ­"), "fr")])
def test_one_language(profiles, text, want):
    found = L.segments(profiles, text)
    assert [s[2] for s in found] == [want] and 0.25 <= found[0][3] <= 1


def test_segments_of_a_mixed_text(profiles):
    found = L.segments(profiles, f"{DE} {DE}\n{FR}\n{EN}\nArbeitsort: Yvorens\nPensum: 80%")
    assert [s[2] for s in found] == ["de", "fr", "en"]
    assert L.segments(profiles, f"{DE} Ihre Ansprechperson ist Emily Brown.")[-1][2] == "de"
    flat = " ".join([DE] * 4 + [FR] * 4).lower().replace(".", "").replace(",", "")
    assert {s[2] for s in L.segments(profiles, flat)} == {"de", "fr"}


def test_the_shortcut_equals_bundled_vectors(profiles):
    import numpy as np

    rng = np.random.default_rng(7)
    letters = rng.choice(np.array([-1, 1], dtype=np.int8), (L._N, L.DIMENSION)).astype(float)
    one = lambda g: np.roll(letters[g // L._N**2], 2) * np.roll(letters[g // L._N % L._N], 1) * letters[g % L._N]
    known = [g for g in L.Profiles.runs(DE) if g and profiles.table[g, 0] != 0]
    bundle = sum(one(g) for g in known)
    direct = profiles.table[known].sum(axis=0)
    total = sum(profiles.table[g] for g in known)
    assert np.allclose(direct, total, atol=1e-3)
    # Lengths of bundles: the square root of dimension and runs, up to repeats.
    assert 0.8 < np.linalg.norm(bundle) / np.sqrt(L.DIMENSION * len(known)) < 1.5


@pytest.mark.parametrize("label,want", [("de-CH", "de"), ("Deutsch", "de"), ("français", "fr"), ("ita", "it"), ("en_GB", "en"), ("es", None), (None, ""), (" - ", ""), ("und", ""), ("Unknown", "")])
def test_labels(label, want):
    assert L.label_language(label) == want


def test_mislabelled(spark, profiles):
    ads = [("ok", "t", DE, "x"), ("none", "t", FR, "x"), ("wrong", "t", IT, None), ("mixed", "t", f"{DE}\n{EN}", None), ("title", "Wir suchen eine Person für unser Team", "  ", None), ("empty", None, None, None), ("signs", "!", "123 !!", None), ("none", "t", FR, "again"), ("long", "t", f"{EN} " * 3000, None)]
    labels = [("ok", "Deutsch", "a"), ("wrong", "de", "a"), ("mixed", "de", "a"), ("none", None, None), ("long", "EN", None)]
    got = sorted(tuple(r) for r in L.mislabelled(spark.createDataFrame(ads, "uid string, title string, content_clean string, lang string"), spark.createDataFrame(labels, "uid string, lang string, label_source string"), profiles).collect())
    assert got == [("mixed", "de"), ("mixed", "en"), ("none", "fr"), ("title", "de"), ("wrong", "it")]
