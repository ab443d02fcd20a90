import pytest

from quern.llm.encodings import has_steps, restore, restore_texts
from tests.conftest import rows

CLEAN = {
    "en": "It’s Grimmir’s déjà vu: the same “free” drake, the same £39 bet, plus ½ a wave at a 45° angle — pure cliché.",
    "fr": "Le supporteur a complètement oublié l’inhibiteur pendant que l’équipe s’était déconnectée; Œthryn préférait échanger à côté.",
    "de": "Der müde Schütze überprüfte den äußeren Turm völlig überflüssig während die Übermacht zurücklief.",
    "es": "El compañero dejó pasar el dragón de montaña según el resumen, ¿y así terminó la lección de la mañana?",
    "pt": "A seleção inteira não disputou o dragão ancião; NÃO HÁ DÚVIDA: a dupla “IRMÃ” e AMANHÃ… na lane da MANHÃ™.",
    "pl": "Zmęczony gracz zdążył wziąć drugiego herolda, źle ocenił zewnętrzną wieżę dość bezmyślnie.",
    "ru": "Уставший капитан проиграл большую волну перед самым концом и потерял преимущество по золоту.",
    "ko": "주장 골드 격차를 연결이 끊겨서 훔쳤다. 후방 전체 외곽 포탑을 예상과 달리 놓쳤다.",
}
DAMAGE = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("utf-8", "cp1250"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp949", "latin-1"), ("cp1252", "mac_roman"), ("iso8859_2", "latin-1")]


def damaged(text, written, read):
    try:
        return text.encode(written).decode(read)
    except UnicodeError:
        return None


@pytest.mark.parametrize("lang", CLEAN)
def test_clean_texts_stay(lang):
    found, restored, *_ = restore(CLEAN[lang])
    assert not found and restored == CLEAN[lang]


CASES = [(lang, w, r) for lang in CLEAN for w, r in DAMAGE if (bad := damaged(CLEAN[lang], w, r)) and bad != CLEAN[lang]]


@pytest.mark.parametrize(("lang", "written", "read"), CASES)
def test_damage_is_found(lang, written, read):
    bad = damaged(CLEAN[lang], written, read)
    assert has_steps(bad) and restore(bad)[0], bad


def test_restored_texts():
    exact = sum(restore(damaged(CLEAN[lang], w, r))[1] == CLEAN[lang] for lang, w, r in CASES)
    assert exact >= 0.75 * len(CASES), (exact, len(CASES))


def test_twice_damaged_and_in_places():
    twice = damaged(damaged(CLEAN["fr"], "utf-8", "latin-1"), "utf-8", "latin-1")
    assert restore(twice)[:2] == (True, CLEAN["fr"])
    part = CLEAN["de"] + " Niemand verschenkte die Ã¼bliche BrÃ¼cke."
    assert restore(part)[:2] == (True, CLEAN["de"] + " Niemand verschenkte die übliche Brücke.")
    assert restore("Personne Ã  part lui n’a protÃ©gÃ© la tour.")[1] == "Personne à part lui n’a protégé la tour."


@pytest.mark.parametrize(
    "text",
    ["Ãrvem and Âlbrun met Ðorgul, Žeravin and Nåkkir.", "gro&#223;e Welle f&uuml;r zwei", "Le thé a été préféré", "👍🏽👩‍👩‍👧 gg wp 🏳️‍🌈", "ＧＧ　ＷＰ", "x² ± 3µ ≥ √2 · ∞", "mid\xa0lane ​swap", "a‑b № 5", "plain"],
)
def test_no_cases(text):
    assert not restore(text)[0]


def test_lost_letters():
    assert restore("dej� pasar la ventaja")[0]
    assert not restore("the sign � alone")[0]


def test_corpus(spark):
    bad = damaged(CLEAN["es"], "utf-8", "cp1252") or damaged(CLEAN["es"], "utf-8", "latin-1")
    data = [(1, bad, True), (1, bad, True), (2, None, True), (3, "", True), (4, CLEAN["es"] * 2000, True), (None, bad, True), (5, CLEAN["pl"] * 500 + bad, True)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, found boolean")
    got = restore_texts(df)
    assert rows(got.where("found").select("doc_id")) == sorted([(1,), (1,), (None,), (5,)], key=repr)
    assert {r["restored"] for r in got.where("doc_id = 1").collect()} == {CLEAN["es"]}
    assert rows(restore_texts(df.limit(0))) == []


LONE = ["résumé", "für", "déjà vu", "la señal", "średnia", "Œuvre fête", "seleção dragão", "Der müde Schütze überprüfte den Turm"]


@pytest.mark.parametrize("read", ["gbk", "cp949", "cp932"])
@pytest.mark.parametrize("text", LONE)
def test_lone_letters_read_with_two_byte_codecs(text, read):
    bad = damaged(text, "utf-8", read)
    assert bad != text and has_steps(bad) and restore(bad)[:2] == (True, text), bad


@pytest.mark.parametrize("read", ["gbk", "cp949", "cp932"])
@pytest.mark.parametrize("lang", CLEAN)
def test_two_byte_damage_is_found(lang, read):
    bad = CLEAN[lang].encode().decode(read, "replace")
    assert has_steps(bad) and restore(bad)[0], bad


@pytest.mark.parametrize("text", ["Grimmir처럼 mid를 MVP는 CS체크 gg요", "baron 체크 책 첫 수 jungle캠프", "Grimmir처 Fenlia채 Ashorb초"])
def test_hangul_next_to_latin_is_no_case(text):
    assert not restore(text)[0]


def named(text):
    from html.entities import codepoint2name

    return "".join(f"&{codepoint2name[ord(c)]};" if ord(c) in codepoint2name and ord(c) > 127 else c for c in text)


FORMS = {
    "named": named,
    "decimal": lambda t: "".join(c if c.isascii() else f"&#{ord(c)};" for c in t),
    "hexadecimal": lambda t: "".join(c if c.isascii() else f"&#x{ord(c):X};" for c in t),
    "references of references": lambda t: "".join(c if c.isascii() else f"&amp;#{ord(c)};" for c in t),
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("lang", CLEAN)
def test_damage_written_as_references(lang, form):
    write = FORMS[form]
    clean = CLEAN[lang]
    assert not restore(write(clean))[0]
    bad = damaged(clean, "utf-8", "latin-1")
    assert has_steps(write(bad))
    found, restored, path, *_ = restore(write(bad))
    assert found and restored == restore(bad)[1] and (path.startswith("unescape") or "&" not in write(bad))


def test_references_in_places():
    assert restore("tr&#195;&#168;s forc&#195;&#169;e")[:2] == (True, "très forcée")
    assert restore("La &lt;b&gt; vraie tr&#195;&#168;s forc&#195;&#169;e &amp; s&ucirc;re")[:2] == (True, "La <b> vraie très forcée & sûre")
    assert restore("Le thÃ© a Ã©tÃ© prÃ©fÃ©rÃ© &amp; bu")[:2] == (True, "Le thé a été préféré &amp; bu")
    for clean in ("a dupla &#8220;IRM&#195;&#8221; e AMANH&#195;&#8230;", "MANH&Atilde;&trade;", "MANHÃ&trade;", "sp&#228;t gew&#228;hlt &amp; s&#252;&#223;", "&" + "amp;" * 200_000 + "lt;", "&;&#;&#x;&#xZ;&nosuch;"):
        assert not restore(clean)[0], clean


def test_no_limit_of_states():
    """Lines damaged in many ways, twice as well: more states than are searched at once; every line comes back."""
    ways = [("cp1252",), ("cp437",), ("mac_roman",), ("cp850",), ("cp866",), ("latin-1",), ("latin-1", "latin-1"), ("cp437", "cp437")]
    lines, want = [], []
    for n in range(40):
        for lang in ("fr", "de", "es"):
            clean = bad = CLEAN[lang]
            for read in ways[n % len(ways)]:
                bad = damaged(bad, "utf-8", read) or bad
            if bad != clean:
                lines.append(bad)
                want.append(clean)
    found, restored, *_ = restore("\n".join(lines))
    assert found and restored.split("\n") == want


@pytest.mark.parametrize("lang", CLEAN)
def test_nothing_is_left_out_of_the_search(lang):
    """Where has_steps says no, the search itself has nothing to find."""
    words = CLEAN[lang].split()
    for w, r in DAMAGE:
        for n in (1, 2, 3, 5):
            for a in range(0, len(words) - n + 1, n):
                part = " ".join(words[a : a + n])
                for text in {part, damaged(part, w, r) or part}:
                    assert has_steps(text) or restore(text)[:2] == (False, text)


def test_lost_bytes_that_only_one_sign_can_have():
    assert restore("the same â€œfreeâ€� drake and itâ€™s all")[1] == "the same “free” drake and it’s all"


def test_symbols_and_bytes_of_no_text():
    noise = bytes(range(256)).decode("latin-1") * 40
    restore(noise)
    restore(noise.replace(" ", "").replace("\n", ""))
