"""Evaluation texts leaking into training text: template windows, slot checks, exact alignment."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import spread

RESULT_SCHEMA = "doc_id bigint, item_id bigint, kind string, words int, edits int, doc_word int, changed_slots int"

NUMBER, NAME, UNIT, MEASURE = 1, 2, 3, 4

_VALUE = r"""\s+[\w:.@-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'|[^\s"'<>]+)"""
# A tag of any length has values for at least every other attribute; else prose between "a <b" and "c> d" would be a tag.
_TAG = re.compile(rf"</?[A-Za-z][^<>]{{0,200}}>|<[A-Za-z][\w:-]*(?:(?:\s+[\w:.@-]+)?{_VALUE})+(?:\s+[\w:.@-]+)?\s*/?>")
_SPLIT = re.compile(r"[—–/|…]+")
_MARKS = re.compile(r"[^\w\s]+|_+")
_INNER = re.compile(r"\w[-_‑]\w")


class _Unmarked(dict):
    """Translation table that drops combining marks and invisible characters."""

    def __missing__(self, o: int):
        self[o] = None if unicodedata.category(chr(o)) in ("Mn", "Me", "Cf") else o
        return self[o]


_UNMARKED = _Unmarked()


def plain(text: str) -> str:
    """Without markup, character references, accents and invisible characters; case and punctuation are kept."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_UNMARKED)
    return _SPLIT.sub(" ", text)


def words_of(text: str) -> list[str]:
    """Words for comparison: white space parts words, punctuation within a word is left out."""
    return _MARKS.sub("", plain(text).casefold()).split()


# Words that follow a number as its unit, in the form words_of gives them.
UNITS = frozenset(
    words_of(
        "second seconds minute minutes hour hours day days week weeks point points coin coins gold percent meter meters metre metres km kg experience "
        "seconde secondes heure heures jour jours semaine semaines pièce pièces or écu écus balises mètre mètres expérience "
        "Sekunde Sekunden Minuten Stunde Stunden Tag Tage Tagen Woche Wochen Punkt Punkte Punkten Münze Münzen Prozent Metern Erfahrung "
        "segundo segundos minuto minutos hora horas día días semanas semana punto puntos moneda monedas oro metro metros experiencia "
        "dia dias ponto pontos moeda moedas ouro experiência "
        "sekunda sekundy sekund sekundę sekundzie minuta minuty minut minutę minucie godzina godziny godzin godzinę godzinie dzień dni dniu tydzień tygodnie tygodni tygodniu "
        "punkt punkty punktów punktu moneta monety monet monetę złoto złota sztuka sztuki sztuk procent procenty metr metry metrów metra doświadczenia "
        "секунда секунды секунд секунду секунде минута минуты минут минуту минуте час часа часов часу день дня дней неделя недели недель неделю неделе "
        "очко очка очков балл балла баллов монета монеты монет монету золото золота процент процента процентов метр метра метров км кг опыта "
        "초 분 시간 일 주 점 포인트 코인 골드 퍼센트 미터 경험치"
    )
)
# The Korean units, which stand at their number and before particles within one word: 20분에.
_MEASURE = re.compile(r"\d+(?:%s)" % "|".join(words_of("초 분 시간 일 주 점 포인트 코인 골드 퍼센트 미터 경험치")))


def _slot_type(word: str) -> int | None:
    """NUMBER, UNIT or MEASURE (number and unit in one word) by the word alone."""
    if word.isdecimal():
        return NUMBER
    if word in UNITS:
        return UNIT
    return MEASURE if word[:1].isdecimal() and _MEASURE.match(word) else None


def _named_words(text: str) -> tuple[list[str], set[str]]:
    """The words of a text and those that look like names: inner hyphens, or capitals within a sentence."""
    out, names, start = [], set(), True
    for raw in plain(text).split():
        w = _MARKS.sub("", raw.casefold())
        if w:
            out.append(w)
            if not w.isdecimal() and (_INNER.search(raw) or (not start and raw[:1].isupper() and not raw.isupper())):
                names.add(w)
            start = raw[-1] in ".!?:"
    return out, names


def vocabulary(texts: Iterable[str | None], least_words: int) -> dict[str, int]:
    """Template id of every word of the items: its type, also where only one of all items writes it as a name."""
    words: dict[str, None] = {}
    names: set[str] = set()
    for text in texts:
        ws, ns = _named_words(text) if text else ([], set())
        if len(ws) >= least_words:
            words.update(dict.fromkeys(ws))
            names |= ns
    return {w: _slot_type(w) or (NAME if w in names else k + 10) for k, w in enumerate(words)}


class TemplateIndex:
    """Windows of the items' templates by hash. It holds one block of items and is sent to the tasks.

    ids is the `vocabulary` of all items, of which the block may be a part: what counts as a name, and which words no
    item has, do not depend on how items fall into blocks.
    """

    def __init__(self, items: list[tuple[int, str]], least_words: int, per_edit: int, ids: dict[str, int] | None = None):
        import numpy as np

        self.least, self.per_edit = least_words, per_edit
        self.most_edits = (2 * least_words - 1) // per_edit
        #: Some stretch without an edit is at least so long in any passage of least_words or more.
        self.width = min(-(-(n - n // per_edit) // (n // per_edit + 1)) for n in range(least_words, 2 * least_words))
        #: By place in the block: two rows may have one id.
        self.owner: list[int] = []
        self.words: list[list[str]] = []
        for item_id, text in items:
            ws = _named_words(text)[0]
            if len(ws) >= least_words:
                self.owner.append(item_id)
                self.words.append(ws)
        self.ids = vocabulary((text for _, text in items), least_words) if ids is None else ids
        places: dict[int, list[tuple[int, int]]] = {}
        for place, ws in enumerate(self.words):
            for a, h in enumerate(self.hashes(np.array([self.ids[w] for w in ws], dtype=np.int64)).tolist()):
                places.setdefault(h, []).append((place, a))
        self.places = places
        self.known = np.array(sorted(places), dtype=np.uint64)

    def hashes(self, ids):
        """A 64-bit hash of every window of width template ids."""
        import numpy as np

        n = len(ids) - self.width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        u = (ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(self.width):
            h = h * np.uint64(0x100000001B3) + (u[k : k + n] ^ (u[k : k + n] >> np.uint64(29)))
        return h

    def template_ids(self, words: list[str]):
        """(template ids of a document's words, which words no item has); such a word is taken for a name at first."""
        import numpy as np

        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        for i in np.flatnonzero(ids < 0).tolist():
            ids[i] = _slot_type(words[i]) or -1
        unknown = ids < 0
        ids[unknown] = NAME
        return ids, unknown

    def hits(self, ids) -> list[tuple[int, int, int]]:
        """(document word, place of the item, item word) of every window that some item's template has too."""
        import numpy as np

        h = self.hashes(ids)
        if not len(h) or not len(self.known):
            return []
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        found = np.flatnonzero(self.known[at] == h)
        return [(b, item, a) for b in found.tolist() for item, a in self.places[int(h[b])]]


def _reach(a: list[str], b: list[str], i: int, j: int, most: int, step: int) -> list[int]:
    """For each number of edits up to most: words of a that can be covered from (i, j) in direction step.

    Furthest reach by diagonal; a reach counts where it ends with equal words.
    """
    n, m = (len(a) - i, len(b) - j) if step > 0 else (i + 1, j + 1)

    def slide(x: int, k: int) -> int:
        while x < n and 0 <= x + k < m and a[i + step * x] == b[j + step * (x + k)]:
            x += 1
        return x

    now = {0: slide(0, 0)}
    best = [now[0]]
    for _ in range(most):
        nxt: dict[int, int] = {}
        for k, x in now.items():
            for kk, xx in ((k, x + 1), (k - 1, x + 1), (k + 1, x)):
                if xx <= n and 0 <= xx + kk <= m and nxt.get(kk, -1) < xx:
                    nxt[kk] = xx
        top = best[-1]
        for k, x in nxt.items():
            nxt[k] = slide(x, k)
            if nxt[k] > x:
                top = max(top, nxt[k])
        now = nxt
        best.append(top)
    return best


def passage(item: list[str], doc: list[str], a: int, b: int, least: int, per_edit: int, most: int) -> tuple[int, int] | None:
    """(words, edits) of the longest passage through the equal words item[a], doc[b] that is long and exact enough."""
    right = _reach(item, doc, a, b, most, 1)
    left = _reach(item, doc, a - 1, b - 1, most, -1) if a and b else [0] * (most + 1)
    best = None
    for e in range(most + 1):
        n = max(left[x] + right[e - x] for x in range(e + 1))
        if n >= least and e * per_edit <= n and (best is None or n > best[0]):
            best = (n, e)
    return best


def _slots_agree(item: list[str], doc: list[str], ids, a: int, b: int, n: int) -> int:
    """Number of slots that a re-parameterised copy changes; 0 if a value is not replaced the same way everywhere."""
    to: dict[str, str] = {}
    back: dict[str, str] = {}
    for x, y, t in zip(item[a : a + n], doc[b : b + n], ids[b : b + n]):
        if t in (NUMBER, NAME, UNIT, MEASURE) and (to.setdefault(x, y) != y or back.setdefault(y, x) != x):
            return 0
    return sum(x != y for x, y in to.items())


def find_in(index: TemplateIndex, text: str) -> list[tuple[int, str, int, int, int, int]]:
    """(item, kind, words, edits, document word, changed slots) of one document, one row per item and kind."""
    words = words_of(text)
    if len(words) < index.width:
        return []
    ids, unknown = index.template_ids(words)
    w = index.width
    names: set[str] | None = None
    best: dict[tuple[int, str], tuple[int, int, int, int]] = {}
    copied: dict[tuple[int, int], int] = {}
    runs: dict[tuple[int, int], list[list[int]]] = {}
    for b, item, a in index.hits(ids):
        new = unknown[b : b + w].nonzero()[0]
        if len(new):
            names = _named_words(text)[1] if names is None else names
            if any(words[b + i] not in names for i in new.tolist()):
                continue
        own = index.words[item]
        own_runs = runs.setdefault((item, b - a), [])
        if own_runs and own_runs[-1][1] == b - 1:
            own_runs[-1][1] = b
        else:
            own_runs.append([b, b])
        if words[b : b + w] == own[a : a + w]:
            again = copied.get((item, b - a)) == b - 1
            copied[item, b - a] = b
            if again:
                continue
            p = passage(own, words, a, b, index.least, index.per_edit, index.most_edits)
            if p and p > best.get((item, "passage"), (0,))[:2]:
                best[item, "passage"] = (*p, b, 0)
    for (item, diagonal), own_runs in runs.items():
        for start, last in own_runs:
            n = last - start + w
            if n >= index.least and n > best.get((item, "template"), (0,))[0]:
                changed = _slots_agree(index.words[item], words, ids, start - diagonal, start, n)
                if changed:
                    best[item, "template"] = (n, 0, start, changed)
    return [(index.owner[item], kind, *x) for (item, kind), x in best.items()]


def _batches(shared, words):
    def run(batches):
        import pyarrow as pa

        index: TemplateIndex = shared.value
        index.ids = words.value
        types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        names = ("doc_id", "item_id", "kind", "words", "edits", "doc_word", "changed_slots")
        for b in batches:
            rows, known = [], {}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    if text not in known:
                        known[text] = find_in(index, text)
                    rows += [(doc_id, *r) for r in known[text]]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, types)], names=list(names))

    return run


def leaks(documents: DataFrame, items: DataFrame, least_words: int = 20, per_edit: int = 8, block: int = 2000) -> DataFrame:
    """doc_id, item_id, kind, words, edits, doc_word, changed_slots: which documents contain which items (RESULT_SCHEMA).

    kind 'passage': at least least_words successive words of the item stand in the document, with at most one edit
    (word dropped, added or replaced) for every per_edit of them; the passage begins and ends with equal words. Case,
    accents, punctuation, spacing, invisible characters and markup do not matter. kind 'template': as many words of
    the item's template (numbers, names and units replaced by their type) with other values, each value replaced the
    same way throughout: a re-parameterised item. One row for each document, item and kind, of the longest passage.

    Windows of template words are hashed on both sides and joined; the slots of a joined window then tell copies from
    re-parameterised ones, and copies are aligned exactly. A passage always holds a window without an edit, so the
    join loses none. The items are the stated queries: their windows are broadcast in blocks of at most `block`
    items, each block meeting all documents, so that a task holds the windows of one block at a time; the result does
    not depend on the blocks. The items' word list is sent as well, once for all blocks.

    Null and empty texts, and items of fewer than least_words words, are in no result. Repeated documents are
    each answered; rows of items with the same id are different texts of that item. Texts of any length are read
    whole. No shuffle besides the final one by (document, item, kind).
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    n = items.count()
    parts = -(-n // block) or 1
    if not n:
        return spark.createDataFrame([], RESULT_SCHEMA)
    own = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    # One word list for all blocks: read item by item, it grows with the items' words, not with the documents.
    ids = vocabulary((r[0] for r in own.select("text").toLocalIterator()), least_words)
    words = spark.sparkContext.broadcast(ids)
    found = []
    for k in range(parts):
        mine = own if parts == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        index = TemplateIndex([tuple(r) for r in mine.collect()], least_words, per_edit, ids)
        index.ids = {}  # sent once, on its own
        found.append(docs.mapInArrow(_batches(spark.sparkContext.broadcast(index), words), RESULT_SCHEMA))
    every = reduce(DataFrame.unionByName, found)
    longest = F.max(F.struct("words", F.negate("edits").alias("e"), "doc_word", "changed_slots")).alias("x")
    return every.groupBy("doc_id", "item_id", "kind").agg(longest).select(
        "doc_id", "item_id", "kind", "x.words", F.negate("x.e").alias("edits"), "x.doc_word", "x.changed_slots"
    )
