import random

from tasklattice.llm import name_variants
from tasklattice.llm.name_variants import linked_names, name_cost, read_name

FIRM_A = ["Kiletagus Verlag Sàrl", "KILETAGUS VERLAG SÀRL", "Ki1etagus Verlag S.à r.l.", "Kiletagus Verlag Sàrl, Filiale Yvorens", "Verlag Kiletagus Sàrl", "Kiletgaus Verrlag", "Kiletagus Verl.", "Kiletagus Verlag (Schweiz) Sàrl", "Kiletagus Verlag HR"]
FIRM_B = ["Kiletagus Energie AG", "Kiletagus Energie Aktiengesellschaft", "Kiletagus Enerie"]
FIRM_C = ["Giuseppe Midranisur Holzbau Thurnegg & Co. KG", "Beppe Midranisur Holzbau Thurnegg & Co KG", "G. Midranisur Holzbau Thurnegg & Co. KG", "Midranisur, Giuseppe Holzbau Thurnegg & Co. KG"]


def test_reading():
    assert read_name("Keflutasa Med.-Technik S.A.")[1] == ["sa"]
    assert read_name("k.A.") == ([], []) and read_name("-")[0] == []
    assert name_cost(*(read_name(x)[0] for x in ("Keflutasa Med.-Technik", "Keflutasa Medizintechnik Sàrl"))) == 0
    assert name_cost(*(read_name(x)[0] for x in ("Kiletagus Gartenbau", "Kiletagus Gerätebau"))) == 9


def test_links(spark):
    rows = [(n, False, "x") for n in FIRM_A + FIRM_B + FIRM_C] + [(FIRM_A[0], None, "y"), ("Plotraris Treuhand GmbH", True, ""), ("Plotraris Treuhand", True, ""), ("Plotraris Treuhand Sàrl", False, ""), ("Anonym", False, ""), ("k.A.", None, ""), ("-", None, ""), (None, None, None), ("", True, None), ("Z" * 5000, None, None)]
    got = {tuple(r) for r in linked_names(spark.createDataFrame(rows, "company_name string, company_is_recruiter boolean, firm string")).collect()}
    want = {(a, b) for f in (FIRM_A, FIRM_B, FIRM_C, ["Plotraris Treuhand GmbH", "Plotraris Treuhand"]) for a in f for b in f if a < b}
    assert got == want


def test_empty(spark):
    assert linked_names(spark.createDataFrame([], "company_name string, company_is_recruiter boolean")).count() == 0


def _meet(x, y, hot):
    """Whether two spellings share a key when the keys of ``hot`` are refined."""
    both = name_variants._outer_keys(x) & name_variants._outer_keys(y)
    if both - hot:
        return True
    p, q = name_variants._refined_keys(x, hot), name_variants._refined_keys(y, hot)
    return any(p[k] or q[k] for k in p.keys() & q.keys())


def test_every_match_shares_a_key_however_hot():
    rng = random.Random(5)
    words = ["muller", "mueller", "immobilien", "immo.", "imm.", "m.", "giuseppe", "beppe", "peppe", "treuhand", "traeuhaend", "bau", "baue", "aebi", "abi", "zug", "verlag", "verl."]

    def typo(w):
        i = rng.randrange(len(w))
        return w if w[-1] == "." else rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aelx") + w[i:], w[:i] + rng.choice("aelx") + w[i + 1 :]]) or w

    names = {" ".join(sorted(typo(w) if rng.random() < 0.3 else w for w in rng.sample(words, rng.choice([1, 2, 2, 3, 4])))) for _ in range(700)}
    names = sorted(names)
    hot = set().union(*(name_variants._outer_keys(x) for x in names))
    matching = [(x, y) for i, x in enumerate(names) for y in names[:i] if name_cost(x.split(" "), y.split(" ")) <= 2]
    assert len(matching) > 100
    assert [(x, y) for x, y in matching if not (_meet(x, y, set()) and _meet(x, y, hot))] == []


def test_links_do_not_depend_on_the_size_of_the_table(spark):
    pair = ["Müller Immo.", "Müller Immobilien"]
    many = ["Müller " + "".join(c * 3 for c in (a, b, a)) for a in "bcdfghjk" for b in "lmnpqrst"]
    got = {tuple(r) for r in linked_names(spark.createDataFrame([(n, None) for n in pair + many], "company_name string, company_is_recruiter boolean")).collect()}
    assert tuple(sorted(pair)) in got and all(not set(p) & set(pair) for p in got if set(p) != set(pair))


def test_names_of_short_words(spark):
    firms = (["UBS AG", "UBS", "Ubs (Schweiz) AG", "U.B.S."][:3], ["SBB CFF", "SBB CFF AG", "CFF SBB"], ["ABB AG", "ABB Aktiengesellschaft"])
    other = ["UBA AG", "SBB", "AB", "Abb Bau"]
    got = {tuple(r) for r in linked_names(spark.createDataFrame([(n, None) for f in firms for n in f] + [(n, None) for n in other], "company_name string, company_is_recruiter boolean")).collect()}
    assert got == {(a, b) for f in firms for a in f for b in f if a < b}


def test_membership_gives_the_same_links(spark):
    df = spark.createDataFrame([(n, None) for n in FIRM_A + FIRM_B + ["Anonym"]], "company_name string, company_is_recruiter boolean")
    firm = {r.company_name: r.firm for r in name_variants.firms(df).collect()}
    assert set(firm) == set(FIRM_A + FIRM_B)
    assert {tuple(r) for r in linked_names(df).collect()} == {(a, b) for a in firm for b in firm if a < b and firm[a] == firm[b]}
