import pytest

from tasklattice.llm.personal_information import Plain, found_types, mask_ads, masked

CASES = [
    ("Senden Sie Ihr Dossier an hr+12@firma.example. Danke", "Senden Sie Ihr Dossier an [EMAIL]. Danke"),
    ("Write to anna.b [at] mail[dot]firm[dot]test\nNext", "Write to [EMAIL]\nNext"),
    ("Ci scriva: olv_6 @ mail.ditta.test\nDopo", "Ci scriva: [EMAIL]\nDopo"),
    ("Tel. 0041 91 555 12 52, bitte", "Tel. [PHONE], bitte"),
    ("Rufen Sie an (078/555.71.60).", "Rufen Sie an ([PHONE])."),
    ("Call +41 (0)91 555 1252 or (031) 555 95 73.", "Call [PHONE] or [PHONE]."),
    ("Ruf an: null sieben acht fünf fünf fünf eins zwei drei vier.", "Ruf an: [PHONE]."),
    ("AHV 756.9536.3776.19 bitte", "AHV [NATIONAL_ID] bitte"),
    ("Passport no. X1234567 must be quoted", "Passport no. [NATIONAL_ID] must be quoted"),
    ("Post bitte an Mühlefeldweg 61, 4610 Ort.", "Post bitte an [ADDRESS], 4610 Ort."),
    ("Courrier à 10a, rue du Vieux-Moulin.", "Courrier à [ADDRESS]."),
    ("Posta a via dei Larici 22b, 6000 Monte.", "Posta a [ADDRESS], 6000 Monte."),
    ("Letters go to 27b Old Mill Road in Town.", "Letters go to [ADDRESS] in Town."),
    ("Ihre Ansprechperson ist Herr Gubovic.", "Ihre Ansprechperson ist [NAME]."),
    ("auskunft gibt ihnen gerne frau regula olvisser.", "auskunft gibt ihnen gerne [NAME]."),
    ("Votre personne de contact est LOMBVONI Luc.", "Votre personne de contact est [NAME]."),
    ("La persona di contatto è P. Gubovic.", "La persona di contatto è [NAME]."),
    ("Olvaux, Tamara is happy to answer.", "[NAME] is happy to answer."),
    ("Ihre\tAnsprechperson  ist\xa0Herr   Gubovic .", "Ihre\tAnsprechperson  ist\xa0[NAME] ."),
    ("L'adresse suivante :96b,  rue  du Vieux-Moulin.", "L'adresse suivante :[ADDRESS]."),
    # names that no phrase announces
    ("Please call Dorothea Zumstein on 044 555 31 22.", "Please call [NAME] on [PHONE]."),
    ("Contact: Wojciech Szymański", "Contact: [NAME]"),
    ("For details reach out to Priyanka Raghunathan.", "For details reach out to [NAME]."),
    ("Bei Fragen hilft Thorvald Kröger gerne.", "Bei Fragen hilft [NAME] gerne."),
    ("Senden Sie Ihr Dossier an Wanda Miskovic, wanda.miskovic@firma.example", "Senden Sie Ihr Dossier an [NAME], [EMAIL]"),
    # disguises of two kinds in one address
    ("Write to jon [at] acme dot ch today", "Write to [EMAIL] today"), ("Write to jon at acme [dot] ch today", "Write to [EMAIL] today"), ("mail jon@acme dot ch", "mail [EMAIL]"),
    ("Passport number AB123456", "Passport number [NATIONAL_ID]"), ("AHV 756.1234.5678.90", "AHV [NATIONAL_ID]"),
    # no cases
    *[(x, x) for x in ("Reference number AB123456 applies.", "Artikel 7561234567890 liegt bereit", "Rufen Sie die Human Resources an.", "Contact: Customer Service", "Alle Nutzen Dürfen Kostenlose Parkplätze Nach Der Probezeit.", "The site lies close to Harwick Lane and is easy to reach.", "the point is at acme. Then dot com grew")],
    ("Das Team Verkauf Innendienst erreichen Sie unter 044 555 31 22", "Das Team Verkauf Innendienst erreichen Sie unter [PHONE]"),
    ("Alle Nutzen Kostenlose Parkplätze Hinzu. Rufen Sie An 0041 22 555 38 22", "Alle Nutzen Kostenlose Parkplätze Hinzu. Rufen Sie An [PHONE]"),
    *[(x, x) for x in ("Artikel 8166-649 bleibt im Sortiment.", "Referenz 2018-A9874, Norm 7957:2015", "Das Budget beträgt 422'1718 Franken.", "Der Betrieb liegt nahe der Lindhofstrasse und hat 40 Plätze.", "Eintritt: 24.12.2024", "Im Projekt Anna arbeiten 42 Personen.", "La mise en place de machines pour près de 679 clients.", "Josef Gonadriwe Informatik AG sucht Verstärkung.", "Arbeitsplatz 80%", "Salary band: 6370\nPlace of work: Ort\nWorkload: 85%", "salary band 6370 place of work ort workload 85 start", "Der Lohn liegt zwischen CHF 4'750 und 10'500.", "")],
]


@pytest.mark.parametrize("text,want", CASES)
def test_masking(text, want):
    assert masked(text)[0] == want


def test_offsets_lead_back_to_the_source():
    src = "x­y: ann­a (at) mail (dot) example (dot) org!"
    p = Plain(src)
    a = p.text.index("anna@")
    s, e = p.back(a, len(p.text) - 1)
    assert p.text[a:-1] == "anna@mail.example.org" and src[s:e] == "ann­a (at) mail (dot) example (dot) org"
    assert masked("аnna@exаmple.org")[0] == "[EMAIL]"  # two Cyrillic letters


def test_frames(spark):
    rows = [("a", "Herr Gubovic, Tel. 091 555 12 52", "Firma", "x"), ("a", "Herr Gubovic, Tel. 091 555 12 52", "Firma", "y"), ("b", None, None, None), ("c", " ", None, None), ("d", "nichts", None, None), ("e", "Text " * 40_000 + "a@b.example", None, None)]
    df = spark.createDataFrame(rows, "uid string, content_clean string, company_name string, pii_type string")
    assert sorted(map(tuple, found_types(df).collect())) == [("a", "name"), ("a", "phone"), ("e", "email")]
    got = {r.uid: r for r in mask_ads(df).collect()}
    assert got["a"].masked == "[NAME], Tel. [PHONE]" and got["d"].masked == "nichts" and set(got) == {"a", "d", "e"}
    assert found_types(df.limit(0)).count() == 0
