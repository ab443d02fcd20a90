import random

import pytest

from quern.llm.leaks import TemplateIndex, find_in, leaks, plain, words_of
from tests.conftest import rows

ITEM = (
    "The cryptic rookie called quiet-magpie boldly estimates how often the faint bounty of 487 dwarfs two vivid towers plus the Frost-bound greaves "
    "with tangled draws scored as 29. The elastic rookie named Âlbrun is gladly asked to prove that ignoring Grimdovane yields an inert anchor above a swing of 30 points."
)
WORDS = ITEM.split()
DOCS, ITEMS = "doc_id bigint, text string, item_id int, kind string", "item_id bigint, text string, doc_id int"


def found(text, item=ITEM, kind="passage"):
    return [r for r in find_in(TemplateIndex([(1, item)], 20, 8), text) if r[1] == kind]


def test_lengths():
    pad = "some other words stand here before it all "
    assert found(pad + " ".join(WORDS[3:23]) + " and so on")
    assert not found(pad + " ".join(WORDS[3:20]) + " and so on")
    assert not found(pad)
    assert not found("")


def test_edits():
    r = random.Random(5)
    for n in (20, 24, 32, 40):
        for _ in range(30):
            a = r.randrange(len(WORDS) - n + 1)
            w = WORDS[a : a + n]
            for at in sorted(r.sample(range(1, n - 1), n // 8), reverse=True):
                how = r.randrange(3)
                if how == 0:
                    del w[at]
                elif how == 1:
                    w.insert(at, "perhaps")
                else:
                    w[at] = "indeed"
            assert found("before this " + " ".join(w) + " after that"), w
    w = list(WORDS[:24])
    for at in (2, 5, 8, 11, 14, 17, 20):
        w[at] = "other"
    assert not found(" ".join(w))


def test_other_order():
    w = list(WORDS)
    random.Random(2).shuffle(w)
    assert not found(" ".join(w))
    halves = WORDS[:15] + WORDS[30:] + WORDS[15:30]
    assert not found(" ".join(halves), " ".join(WORDS[:30]))


def test_what_does_not_matter():
    t = " ".join(WORDS[:30])
    forms = [t.upper(), t.replace("-", "").replace(".", ""), t.replace("-", "‑"), t.replace("e", "e​"), t.replace(" ", "\xa0\n "), "<b>" + t.replace(" ", "</b> <i>") + "</i>"]
    forms += [t.replace("Â", "A"), t.replace("Â", "Â"), "> " + t.replace(" the ", "\n> the "), '{"prompt": "' + t + '"}', t.replace("o", "&#111;"), t.replace("a", "ａ")]
    for f in forms:
        assert found(f), f


def test_template_copy():
    other = ITEM.replace("487", "512").replace("quiet-magpie", "loud-raven").replace("29", "31")
    assert found(other, kind="template")[0][5] == 3
    mixed = "The 5 men met 5 others and " + " ".join(WORDS[:25])
    assert not found(mixed.replace("5 others", "6 others").replace("487", "8"), mixed, "template")


def test_copy_after_changed_slots():
    item = " ".join(f"value {i} of part {i} in box {i}" for i in range(7)) + " " + " ".join(WORDS[:24])
    doc = " ".join(f"value {i + 50} of part {i + 50} in box {i + 50}" for i in range(7)) + " " + " ".join(WORDS[:24])
    assert found(doc, item)


def test_corpus(spark):
    docs = [(1, ITEM, 9, "x"), (1, ITEM, 9, "x"), (2, None, 9, "x"), (3, "", 9, "x"), (4, "filler " * 50_000 + ITEM, 9, "x"), (None, ITEM, 9, "x"), (5, "nothing", 9, "x")]
    items = [(7, ITEM, 1), (8, None, 1), (9, "too short", 1), (7, " ".join(WORDS[::-1]), 1)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = sorted([(1, 7), (4, 7), (None, 7)], key=repr)
    for block in (2000, 1):
        got = leaks(d, i, block=block).where("kind = 'passage'").select("doc_id", "item_id")
        assert rows(got) == want
    assert rows(leaks(d, i.limit(0))) == [] and rows(leaks(d.limit(0), i)) == []


def test_words():
    assert words_of("Él &eacute;s — l’option 20:09, x_y <b>Z</b>") == ["el", "es", "loption", "2009", "xy", "z"]


UNIT_ITEMS = [
    ("pl", "Kapitan drużyny obliczył wczoraj wieczorem że zwykły smok wraca po 30 sekund jeżeli każdy gracz czeka spokojnie obok rzeki i nikt nie rusza wieży", "30 sekund", "5 minut"),
    ("ru", "Уставший капитан команды вчера подсчитал что обычный дракон вернётся через 30 секунд если каждый игрок спокойно ждёт возле реки и никто не трогает башню", "30 секунд", "5 минут"),
    ("ko", "지친 주장 은 어제 저녁 평범한 용 이 정확히 30 초 뒤에 돌아온다고 계산했다 만약 모든 선수 가 강 옆에서 조용히 기다리고 아무도 탑 을 건드리지 않으면", "30 초", "5 분"),
    ("ko", "지친 주장 은 어제 저녁 평범한 용 이 정확히 30초 뒤에 돌아온다고 계산했다 만약 모든 선수 가 강 옆에서 조용히 기다리고 아무도 탑 을 건드리지 않으면", "30초", "5분"),
    ("es", "El capitán cansado calculó ayer que el dragón normal vuelve después de 30 monedas si cada jugador espera tranquilo junto al río y nadie toca la torre", "30 monedas", "5 semanas"),
    ("pt", "O capitão cansado calculou ontem que o dragão normal volta depois de 30 moedas se cada jogador espera tranquilo junto ao rio e ninguém toca na torre", "30 moedas", "5 pontos"),
    ("de", "Der müde Kapitän berechnete gestern dass der gewöhnliche Drache nach 30 Stunden wiederkommt wenn jeder Spieler ruhig neben dem Fluss wartet und niemand den Turm berührt", "30 Stunden", "5 Wochen"),
    ("fr", "Le capitaine fatigué calcula hier que le dragon normal revient après 30 secondes si chaque joueur attend calmement près de la rivière et personne ne touche la tour", "30 secondes", "5 semaines"),
    ("en", "The tired captain counted yesterday that the usual dragon comes back after 30 seconds if every player waits calmly beside the river and nobody touches the tower", "30 seconds", "5 metres"),
]


@pytest.mark.parametrize(("lang", "item", "old", "new"), UNIT_ITEMS)
def test_units_of_all_languages(lang, item, old, new):
    got = found(item.replace(old, new), item, "template")
    assert got and got[0][2] == len(item.split()) and got[0][5] == len(old.split())


def test_long_tags():
    w = WORDS[:22]
    link = '<a href="https://example.org/t?' + "&".join(f"utm_{i}=value{i}" for i in range(40)) + '" hidden class=x>'
    style = "<span style='" + "color: red; margin: 0 auto; " * 20 + "'>"
    for tag in (link, style):
        assert len(tag) > 200
        assert found(" ".join(w[:5]) + f" {tag} " + " ".join(w[5:11]) + f" {tag} " + " ".join(w[11:16]) + f" {tag} " + " ".join(w[16:]))
    assert found("where a <b holds, " + " ".join(WORDS) + " and so on until c> d")
    plain("<a x=" + '"' * 5 + "<a b " * 40_000)
    plain("<a" + " b=c d" * 40_000)


def test_templates_do_not_depend_on_blocks(spark):
    """A word that only another item writes as a name is a placeholder in every block."""
    first = "the tired captain counted that the usual dragon near Grimvale comes back after 30 seconds if every player waits calmly beside the river and nobody touches the tower"
    first = first.replace("Grimvale", "grimvale")
    second = "Yesterday the crew of Grimvale wrote a long report about vision control and nobody in the whole team wanted to read it before the second match began"
    copy = first.replace("grimvale", "Ashfordia").replace("30", "45")
    d = spark.createDataFrame([(1, copy, 0, "x")], DOCS)
    i = spark.createDataFrame([(1, first, 0), (2, second, 0)], ITEMS)
    results = [rows(leaks(d, i, block=b).where("kind = 'template'")) for b in (2000, 2, 1)]
    assert results[0] and results[0] == results[1] == results[2]
