import pytest

from vellum.llm import sentences

CASES = [
    ("en", ["Fig. 3 shows 2.5 mm of play.", "Dr. K. Ebbeth drew it anew, i.e. twice.", "Is it closed?", "Yes!"]),
    ("en", ["The flange was drawn by Ostrel Inc.", "Note no. 4 by Mr. Tesslow Co. refers to it!", "Plotting ended at 7 a.m.", "It has a force of 9.5 N.", "Seen along the line H-N.", "Done in 3 in. and 4 ft. of steel."]),
    ("en", ['The label reads "Keep dry. Ask the desk." and hangs above it.', 'The draughtsman noted: "Move it by 3.5 mm."', '"Check the pulley!" was written across it.', "In U.S. Pat. No. 6,060,537 it is left out."]),
    ("de", ["Am 12. Mai wurde Blatt Nr. 856 gem. Abs. 9 geändert.", "Im 2. Schritt gehen 9 Kanten verloren, d. h. etwa 3,5 Prozent.", "Als Werkstoff kommt z. B. Zinn, Zink usw. für den Kolben in Betracht.", "Das Blatt enthält Bügel, Flansch usw.", "Der Prüfer vermerkte: „Der Nocken fehlt.“", "„Nicht drehen!“, steht quer über der Ansicht."]),
    ("fr", ["Selon M. J.-P. Corvanne, la fig. 27 omet le pivot 231 !", "L'étiquette porte « Arrêt! Garder au sec. » près du pivot.", "Le dessinateur écrit : « Déplacer le joint de 2,6 mm. »", "On peut employer, p. ex. le laiton, c.-à-d. un métal."]),
    ("es", ["¡El eje falta en la Fig. 24!", "El lote 252 procede de Tesslow S. A.", "En la hoja 5 el Sr. J. Quintarel anotó 3.5 mm ... y no más.", "¿Está el pistón dibujado?"]),
]


def pieces(text, lang):
    return [text[a:b] for a, b in sentences.units(text, lang)]


@pytest.mark.parametrize("lang,want", CASES)
@pytest.mark.parametrize("label", ["own", None, "zz"])
def test_latin_scripts(lang, want, label):
    assert pieces(" ".join(want), lang if label == "own" else label) == want


def test_other_scripts():
    assert pieces("検査員は「滑車を33.3mm動かすこと。」と述べた。弁座は破線か？第二の軸。", "ja") == ["検査員は「滑車を33.3mm動かすこと。」と述べた。", "弁座は破線か？", "第二の軸。"]
    assert pieces("制图员写道：“将阀座移动59.4毫米。”驱动轴。“停！”制图员指着轴说。图5省略了轴……因此需要补画！完", "zh") == ["制图员写道：“将阀座移动59.4毫米。”", "驱动轴。", "“停！”制图员指着轴说。", "图5省略了轴……因此需要补画！", "完"]
    assert pieces('डॉ. तरविन ने लिखा है "सूखा रखो। रुको।" और रुका। लगभग 3.5 मि.मी. का अंतर है। क्या हुक क्र. 5 है?', "hi") == ['डॉ. तरविन ने लिखा है "सूखा रखो। रुको।" और रुका।', "लगभग 3.5 मि.मी. का अंतर है।", "क्या हुक क्र. 5 है?"]
    assert pieces("ไฟล์ run_1.json ใช้สำหรับ 5 มิลลิเมตรอยู่ แหวนกลวงบางส่วน", "th") == ["ไฟล์ run_1.json ใช้สำหรับ 5 มิลลิเมตรอยู่", "แหวนกลวงบางส่วน"]


def test_layout():
    text = "Technical field\n\nA long\nline goes on. It comprises:\n1. the flange, etc.\n2. a plate;\n(a) Turn it. Then lock it.\n- x\n• y 3.5\n \nNext one.The last"
    assert pieces(text, "en") == ["Technical field", "A long\nline goes on.", "It comprises:", "1. the flange, etc.", "2. a plate;", "(a) Turn it.", "Then lock it.", "- x", "• y 3.5", "Next one.", "The last"]


def test_wide_spacing():
    assert pieces("It  has  9.5  N. In\u00a0this z.  B. Zinn; am  3.  Mai. S.  A. Der  Lote.", "de") == ["It  has  9.5  N.", "In\u00a0this z.  B. Zinn; am  3.  Mai.", "S.  A.", "Der  Lote."]


def test_capitals_and_odd_texts():
    assert pieces('METALS SUCH AS TIN, ETC. ARE BARRED. "CHECK THE PAWL!" WAS WRITTEN. SEEN BY MR. X.', "en") == ["METALS SUCH AS TIN, ETC. ARE BARRED.", '"CHECK THE PAWL!" WAS WRITTEN.', "SEEN BY MR. X."]
    assert pieces("COTES DE 5 À 6 MM ... SAUF INDICATION. FIN.", "fr") == ["COTES DE 5 À 6 MM ... SAUF INDICATION.", "FIN."]
    for odd in (None, "", "  \n\n ", "...", "\"", "(((((", "?!?!", "1.", "•"):
        for a, b in sentences.units(odd, None):
            assert odd[a:b].strip() == odd[a:b] != ""


def test_units_cover_all_but_white_space():
    text = "One 1.5 mm. Two!  „Drei. Vier.“ sagt er.\n\n- five\n- six?\n7. seven\tEight" * 300
    spans = sentences.units(text, "de")
    assert all(a < b <= c for (a, b), (c, _) in zip(spans, spans[1:]))
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_table(spark):
    df = spark.createDataFrame([(1, "Ab ab. Cd cd.", "en", 5), (1, "Ab ab. Cd cd.", "en", 5), (2, None, None, 1), (3, "", "th", 1)], "doc_id bigint, text string, lang string, start_pos int")
    got = sorted(tuple(r) for r in sentences.sentences(df).collect())
    assert got == [(1, 0, 6), (1, 0, 6), (1, 7, 13), (1, 7, 13)]
    assert sentences.sentences(df.limit(0)).count() == 0


@pytest.mark.parametrize("opening,closing", [("„", "“"), ("“", "”"), ("«", "»"), ('"', '"'), ("(", ")")])
def test_long_quotations_stay_whole(opening, closing):
    inside = "Keep it dry. Ask the desk! " * 60
    assert pieces(f"It reads {opening}{inside.strip()}{closing} and hangs there. Next one.", "en") == [f"It reads {opening}{inside.strip()}{closing} and hangs there.", "Next one."]


def test_marks_without_a_partner_are_no_quotation():
    assert pieces("The „ mark is odd. It stays open. Next “one” here. Last.", "en")[:1] != [""]
    assert pieces("A 5) comes first. Then (this one. And that. Fin.", "en") == ["A 5) comes first.", "Then (this one.", "And that.", "Fin."]
    assert sentences.quotations("a «b «c» d» (e „f. g“ h)") == ([5, 12], [7, 23]) and sentences.quotations("") == ([], [])


def test_time_is_linear():
    import time

    def took(n):
        text = 'He said "no. yes." and (left. soon.) «Fin.» ' * n
        began = time.perf_counter()
        sentences.units(text, "en")
        return time.perf_counter() - began

    took(100)
    assert took(8_000) < 8 * took(2_000) + 0.5
