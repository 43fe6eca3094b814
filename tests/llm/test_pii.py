import pytest

from lodestrata.llm import pii as P

WORDS = P.lexicon(P.WORDS, P.CASED)

CASES = [
    ("write to jo.doe+x@mail.tarn.test, please", [("email", "jo.doe+x@mail.tarn.test")]),
    ("reply to jo_d (at) mail (dot) tarn (dot) test now", [("email", "jo_d (at) mail (dot) tarn (dot) test")]),
    ("or jo[at]tarn.example or JO AT tarn DOT example.", [("email", "jo[at]tarn.example"), ("email", "JO AT tarn DOT example")]),
    ("邮箱是jo＠tarn.example。", [("email", "jo＠tarn.example")]),
    ("p50@wave is 3, @retry(tries=4) at noon dot", []),
    ("call 226-555-0142 or (267) 555-0132, tel=01632 960204", [("phone", "226-555-0142"), ("phone", "(267) 555-0132"), ("phone", "01632 960204")]),
    ("ring +44 20 7946 0611\n22 rows, 0049 30 23125 242.", [("phone", "+44 20 7946 0611"), ("phone", "0049 30 23125 242")]),
    ("tél. 01.99.00.44.03 / +33 1 99 00 28 71; 电话：100 5550 9462，", [("phone", "01.99.00.44.03"), ("phone", "+33 1 99 00 28 71"), ("phone", "100 5550 9462")]),
    ("my number is four one five five five five oh one four two", [("phone", "four one five five five five oh one four two")]),
    ("Ticket 2026-1775476696, 5 of 4187551234 cases, +19.907 on 2026-02-17, build 3.10.12, task T-4155550142", []),
    ("SSN 000-67-1953, QQ 98 96 17 C, ZX0528499", [("id_number", "000-67-1953"), ("id_number", "QQ 98 96 17 C"), ("id_number", "ZX0528499")]),
    ("Ausweis 09991273452, Handy 03023125001", [("id_number", "09991273452"), ("phone", "03023125001")]),
    ("证件号99165219750606895X已登记", [("id_number", "99165219750606895X")]),
    ("at 40 Quarrow Lane, Apt 12, Lindenrode or PO Box 24, Saint-Orvan", [("address", "40 Quarrow Lane, Apt 12, Lindenrode"), ("address", "PO Box 24, Saint-Orvan")]),
    ("Anschrift: Tallowstraße 171, 07106 Velmont; 157 rue des Fennels, 07791 Halbrueck", [("address", "Tallowstraße 171, 07106 Velmont"), ("address", "157 rue des Fennels, 07791 Halbrueck")]),
    ("寄到云栖市砚山路90号8单元503室，收件人闻人若岫。", [("address", "云栖市砚山路90号8单元503室"), ("name", "闻人若岫")]),
    ("Hi Edda Q. Wexvick, ask for tiber pelbourne. cc M. Norvick, RAVZETTI, Ciro", [("name", "Edda Q. Wexvick"), ("name", "tiber pelbourne"), ("name", "M. Norvick"), ("name", "RAVZETTI, Ciro")]),
    ("Swing Lab and Tempo Coach met at Pine Hollow with the Iron Seven", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert [(k, text[a:b]) for k, a, b in P.find(text, WORDS)] == want


def test_redaction_keeps_the_rest():
    text = "Hi Edda Wexvick,\n  mail jo (at) tarn (dot) example — 226-555-0142!\n"
    assert P.redact(text, P.find(text, WORDS)) == "Hi [NAME],\n  mail [EMAIL] — [PHONE]!\n"


def test_offsets_survive_look_alikes():
    text = "\u200bаbc jо＠tarn.example x"
    (kind, a, b), = P.find(text, WORDS)
    assert kind == "email" and text[a:b] == "jо＠tarn.example"


def test_operator(spark):
    d = spark.createDataFrame([(1, "x\U0001f600 226-555-0142", "c"), (2, None, "c"), (3, "", "c"), (4, "a " * 200_000 + "jo@tarn.example", "c")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in P.find_personal(d).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[1]["spans"]] == [("phone", 4, 15)]
    assert got[2]["redacted"] is None and got[2]["spans"] == [] and got[3]["redacted"] == ""
    assert got[4]["spans"][0]["start"] == 400_001
    assert P.find_personal(d.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Yesterday Emma Brown told the editor", ["Emma Brown"]),
        ("the fee was paid by Maria Gonzalez", ["Maria Gonzalez"]),
        ("Mr. James Baker lives here", ["James Baker"]),
        ("Dr Will Baker called", ["Will Baker"]),
        ("Invoice mailed to Sarah Hill and Peter Young", ["Sarah Hill", "Peter Young"]),
        ("Emma Watson arrived", ["Emma Watson"]),
        ("forward this to john smith", ["john smith"]),
        ("王小明昨天来了", ["王小明"]),
        ("Contactez A. Normire à l'adresse", ["A. Normire"]),
        ("to PO Box 52, Tarnmouth\nRagna Quarfeld wants it", ["Ragna Quarfeld"]),
        ("Subject: gyro spline", []),
        ("In mid-sentence Anna Smith is found", ["Anna Smith"]),
        ("Golden Gate, Monday Morning and the Main Menu", []),
        ("Visit New York, London and Rome", []),
        ("The Supreme Court ruled", []),
        ("ask at the Victoria Station or in Georgia Avenue", []),
        ("A CAUTIOUS MAINTAINER COUNTED THE LANTERNS", []),
        ("高尔夫在这里很流行", []),
    ],
)
def test_names_in_plain_prose(text, want):
    assert [text[a:b] for k, a, b in P.find(text, WORDS) if k == "name"] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to jane dot doe at example dot com today", [("email", "jane dot doe at example dot com")]),
        ("the dot product at point five", []),
        ("he lives at 12 Elm Crescent, Oxford", [("address", "12 Elm Crescent, Oxford")]),
        ("Büro: Berliner Straße 5", [("address", "Berliner Straße 5")]),
        ("at 44 Foo Bar, Springfield, IL 62704", [("address", "44 Foo Bar, Springfield")]),
        ("An Platz 26 klebte der Lehrling", []),
        ("ticket = " + " " * 200 + "+44 20 7946 0208", []),
    ],
)
def test_other_kinds_in_plain_prose(text, want):
    assert [(k, text[a:b]) for k, a, b in P.find(text, WORDS)] == want


def test_a_missing_vocabulary_is_an_error(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(FileNotFoundError):
        P.find_personal(docs, words="/nowhere/words.json")
