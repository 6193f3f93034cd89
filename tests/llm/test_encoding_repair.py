import pytest

from quillmill.llm.encoding_repair import repair, wrongly_decoded

GOOD = [
    "Der Prüfer öffnet die Geräteliste für die Größe der Kisten; übrigens früher als geplant.",
    "L’opératrice répare le château près du théâtre dès l’été, où l’œuvre a été créée.",
    "¿Por qué la compañía midió las piñas mañana? El señor añade más árboles.",
    "A direção já não usa as peças; avaliará a solução amanhã à tarde.",
    "Żona dozorcy wyłączyła żółtą taśmę, a książka zamówień leży obok wejścia głównego.",
    "Бухгалтерия не нашла сломанный замок; Комиссия подписала годовой отчёт вчера.",
    "The “wide” case — see ¶ 368 † and the ¬permanent case ¥62, Ã-type crane at 205 °C ±3 µm.",
    "├── a/\n│   └── b.md\nplain text & more; 100 % <b>",
    "Don’t; it’s €73 per item, § 5 … ½ of résumé® ™",
]


@pytest.mark.parametrize("text", GOOD)
def test_good_texts_stay(text):
    assert repair(text) is None


@pytest.mark.parametrize("text", GOOD[:6])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "mac_roman", "cp850"])
def test_utf8_round_trip(text, wrong):
    raw = text.encode("utf-8")
    try:
        bad = raw.decode(wrong)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw)
    fixed, steps, whole = repair(bad)
    assert fixed == text and whole and steps
    twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in bad.encode("utf-8"))
    assert repair(twice)[0] == text


@pytest.mark.parametrize("text, right, wrong", [(GOOD[0], "cp1252", "cp437"), (GOOD[5], "cp1251", "latin-1"), (GOOD[5], "koi8_r", "cp1251"), (GOOD[4], "iso8859-2", "cp1252")])
def test_single_byte(text, right, wrong):
    fixed, _, _ = repair(text.encode(right).decode(wrong))
    assert fixed == text


def test_parts_and_losses():
    good, bad = GOOD[1], GOOD[0].encode().decode("cp1252")
    assert repair(f"{good}\n\n{bad}")[0] == f"{good}\n\n{GOOD[0]}"
    fixed, steps, whole = repair("Der Pr�fer k�rzt")
    assert not whole and not steps and fixed.startswith("Der Pr")
    assert repair("a&eacute;b caf&#233; Don\\u2019t")[0] == "aéb café Don’t"


def test_frame(spark):
    bad = GOOD[0].encode().decode("cp1252")
    rows = [(1, bad), (1, bad), (2, GOOD[0]), (3, None), (4, ""), (None, bad), (5, bad * 300)]
    got = wrongly_decoded(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as steps", "2 as restored")).collect()
    assert sorted(r.doc_id for r in got) == [1, 5] and all(r.whole for r in got)
    assert wrongly_decoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_garbled_words_behind_stranger_ones():
    odd = " ".join(f"б{chr(97 + i % 26)}ж{chr(97 + i // 26)}ǂбaжbж" for i in range(45))
    good = "größer schließt Prüfung über Tür"
    got = repair(f"{odd} {good.encode().decode('cp1252')}")
    assert got == (f"{odd} {good}", ["cp1252>utf-8"], True)


def test_a_stretch_left_garbled_is_not_whole():
    good = "Die Prüfung schließt über der Tür"
    text = good.encode().decode("cp1252") + " GemÃ¤Ã GrÃ¶Ãe schlieÃt"
    fixed, _, whole = repair(text)
    assert fixed.startswith(good) and "GrÃ¶Ãe" in fixed and not whole


def test_search_equals_trying_every_path():
    """No path of up to three steps leads to a cheaper reading than the search finds."""
    from quillmill.llm import encoding_repair as E

    def cheapest(words):
        best, level = E._cost(words), [(words, 0.0, 0)]
        for _ in range(3):
            after = []
            for state, spent, mode in level:
                for step in E._FOLLOW[mode]:
                    there = tuple(E._better(w, step) for w in state)
                    if there != state:
                        after.append((there, spent + E._charge(step), E._mode(mode, step)))
                        best = min(best, E._cost(there) + after[-1][1])
            level = after
        return best

    broken = [GOOD[0].encode().decode("cp1252"), GOOD[5].encode("koi8_r").decode("cp1251"), GOOD[1].encode("cp1252").decode("cp437"), "GemÃƒÂ¤lde &amp;eacute; Â§ Ã", "Ã±Ã³&nbsp;\\u00e9", GOOD[6], "б ǂб ж²x"]
    for text in broken:
        words = tuple(sorted(set(E._WORD.findall(text)), key=E._strangest)[:4])
        _, gain = E.search(list(words))
        assert abs(E._cost(words) - gain - cheapest(words)) < 1e-6, text
