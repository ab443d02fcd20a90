"""Garbled text from wrong character encodings: a best-first search over re-decodings, guided by plausibility.

A state is a text. Steps re-encode parts of it with one codec and decode them with another, or resolve character
references; states are visited once. A cost for implausible characters orders the search and judges its end: text
that gets much more plausible by a step was decoded wrongly before.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame

from quern.session import spread

RESULT_SCHEMA = "doc_id bigint, found boolean, restored string, path string, cost_before double, cost_after double"

# Letters beyond ASCII of the languages en, fr, de, es, pt, pl and common signs.
LETTERS = set("éèêëàâçùûüôœîïäößáíóúñãõìąćęłńśźż") | set("ÉÈÊËÀÂÇÙÛÜÔŒÎÏÄÖÁÍÓÚÑÃÕĄĆĘŁŃŚŹŻ")
PUNCTUATION = set("’‘“”„«»–—…‑•")
PLAIN_SIGNS = set("£€°½№¡¿§")
# Combining grave, acute, circumflex, tilde, breve, dot, diaeresis, ring, double acute, caron, cedilla, ogonek; keycap and emoji style.
COMMON_MARKS = set("\u0300\u0301\u0302\u0303\u0306\u0307\u0308\u030a\u030b\u030c\u0327\u0328\u20e3\ufe0e\ufe0f")
# The 2,350 syllables of KS X 1001; the other 8,822 are next to unused.
SYLLABLES = frozenset(bytes((a, b)).decode("euc_kr") for a in range(0xB0, 0xC9) for b in range(0xA1, 0xFF))
# The most frequent pairs of letters in Russian words.
RUSSIAN_PAIRS = set(
    "ст но ен то на ов ни ра во ко по ро не го пр ос ре та ри ор ер ал ка ел ть ло от ом ол ли ва од ти ан ле де "
    "ны ит те ат ин об за ве да ск ам ки ла ем ес ор ый ий ой ая ое ие ия ию ую пе ид ил ав ар др до ед ец же ив из "
    "ик им ис их ма ме ми мо му на нн ну нц ог ок оп ош пи пл са св се си сл см со сп сс су тв тр ту уд ус ут уч хо це "
    "че чи чт ша ше ши эт ящ яд ял ря ря ят яя ую юю шн шо ще щу вн вр вс вы га ги гр гу ду еб ев ег ее ещ зо зр".split()
)
# Pairs of (codec the text was read with, codec it was written in).
UTF8_READ_AS = ("cp1252", "cp437", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp850", "cp866", "gbk", "cp932", "cp949")
SINGLE_BYTE = (
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1252", "cp949"), ("cp1252", "gbk"), ("cp1252", "cp932"), ("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("cp1250", "iso8859_2"),
    ("iso8859_2", "cp1250"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "mac_roman"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1250", "cp1252"), ("cp1251", "cp1252"),
)
MULTI_BYTE = {"gbk", "cp932", "cp949"}

LOST = "�"
#: Gain that is enough next to places that are damaged beyond doubt.
LESS = 0.6


@lru_cache(maxsize=8192)
def kind(ch: str) -> tuple[str, float]:
    """Script letter and cost: A ASCII letter, L Latin, C Cyrillic, H Hangul, J CJK, S symbol, . anything harmless."""
    o = ord(ch)
    if o < 128:
        return ("A" if ch.isalpha() else ".", 0.0)
    if 0xAC00 <= o <= 0xD7A3:
        return "H", 0.2 if ch in SYLLABLES else 2.0
    if "а" <= ch <= "я" or "А" <= ch <= "Я" or ch in "ёЁ":
        return "C", 0.2
    if 0x400 <= o <= 0x52F:
        return "C", 3.0
    if ch in LETTERS:
        return "L", 1.0
    if ch in PUNCTUATION:
        return "P", 0.4
    if ch in PLAIN_SIGNS:
        return "S", 0.8
    if o < 0xA0:
        return "S", 6.0
    if ch == LOST or unicodedata.category(ch) in ("Co", "Cn"):
        return "S", 6.0
    if 0x2500 <= o <= 0x259F:
        return "S", 5.0
    if ch == "™":
        return "S", 1.5
    cat = unicodedata.category(ch)
    if cat[0] == "Z" or cat == "Cf":
        return ".", 0.3
    if cat[0] == "M":
        return ".", 1.0 if ch in COMMON_MARKS else 3.0
    if 0xFF61 <= o <= 0xFFDC or 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return "J", 2.0
    if o >= 0x1F000 or 0xFF00 <= o <= 0xFFEF:
        return ".", 0.6
    if cat[0] == "L" and o < 0x250:
        return ("S", 2.0) if ch in "ªºƒˆµ" else ("L", 1.4)
    return "S", 2.5


# Stretches without ASCII white space that hold more than ASCII; a match starts only where a stretch does.
_WORDS = re.compile(r"(?<!\S)[\x21-\x7f\x00-\x08\x0e-\x1f]*+[^\x00-\x7f]\S*+", re.ASCII)


def _words(text: str) -> list[str]:
    """As _WORDS finds them, without their places: bytes are parted faster, and at ASCII white space only."""
    if text.isascii():
        return []
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split() if not w.isascii()]


@lru_cache(maxsize=65536)
def word_cost(w: str) -> float:
    """Implausibility of a stretch without white space."""
    total, ks = 0.0, [kind(c) for c in w]
    letters, run = "ALCHJ", 0
    for i, (k, c) in enumerate(ks):
        ch = w[i]
        total += c
        before = ks[i - 1][0] if i else ""
        after = ks[i + 1][0] if i + 1 < len(ks) else ""
        if k == "S" and ch not in "°½":
            if before and after and before in letters and after in letters:
                total += 3
            elif after and after in letters and c >= 1.5:
                total += 1.5
        elif k == "P":
            if ch not in "’‘‑" and before and after and before in letters and after in letters:
                total += 3
            elif ch in "–—" and before and before in letters:
                total += 1.5
        elif k == "L":
            run += 1
            if run >= 3:
                total += 0.7
            if ch.isupper() and before in ("A", "L") and w[i - 1].islower():
                total += 3
            elif ch.islower() and before in ("A", "L") and after in ("A", "L") and w[i - 1].isupper() and w[i + 1].isupper():
                total += 2
            if ch in "ÂÃ" and after == "S" and (not before or before not in letters):
                total += 2
            if ch == "Ã" and w[i + 1 : i + 2] == "\xa0" and (not before or before not in letters):
                total += 3
            if before == "C" or after == "C":
                total += 3
        elif k == "C":
            if before == "C":
                if ch.isupper() and w[i - 1].islower():
                    total += 2
                if (w[i - 1] + ch).lower() not in RUSSIAN_PAIRS:
                    total += 0.35
            elif before in ("A", "H"):
                total += 3
        elif k == "J" and before in ("H", "A", "L"):
            total += 0.5 if before == "H" else 3
        elif k == "H" and before == "A" and w[i - 1].islower():
            total += 1.5
        elif k == "A" and before in ("C", "H", "J"):
            total += 3
        if k != "L":
            run = 0
    if w.strip() == "Ã":
        total += 3
    return total


def cost(text: str) -> float:
    return sum(map(word_cost, _words(text)))


@lru_cache(maxsize=65536)
def _byte_of(ch: str, codec: str) -> bytes | None:
    try:
        return ch.encode(codec)
    except UnicodeEncodeError:
        return bytes([ord(ch)]) if codec in ("cp1252", "cp1250", "cp1251") and ord(ch) < 256 else None


_RUNS = re.compile(r"[^\x00-\x7f]+(?: $)?")
_CHUNKS = re.compile(r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*")


@lru_cache(maxsize=None)
def _undefined(codec: str) -> tuple[bytes, ...]:
    """Bytes that a codec cannot read, which became replacement characters."""
    return tuple(b for b in (bytes([o]) for o in range(0x80, 0x100)) if b.decode(codec, "replace") == LOST)


def _fill(raw: list[bytes | None], run: str, codec: str) -> None:
    """Puts the lost last byte of a sequence into raw where only one letter or sign can have had it."""
    for i, c in enumerate(run):
        for n in (2, 3):
            if c == LOST and i + 1 >= n and raw[i] is None:
                fits = []
                for b in _undefined(codec):
                    raw[i] = b
                    if _sequence(raw, i + 1 - n) == n and (ch := b"".join(raw[i + 1 - n : i + 1]).decode()) and (ch in LETTERS or ch in PUNCTUATION):
                        fits.append(b)
                raw[i] = fits[0] if len(fits) == 1 else None


def _sequence(raw: list[bytes | None], i: int) -> int:
    """Length of the valid UTF-8 sequence of single bytes at i, or 0."""
    b = raw[i]
    if b is None or not 0xC2 <= b[0] <= 0xF4:
        return 0
    n = 2 if b[0] < 0xE0 else 3 if b[0] < 0xF0 else 4
    part = raw[i : i + n]
    if len(part) < n or any(p is None or not 0x80 <= p[0] <= 0xBF for p in part[1:]):
        return 0
    try:
        b"".join(part).decode()
    except UnicodeDecodeError:
        return 0
    return n


def _is_utf8(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


def _writable(run: str, codec: str) -> list[tuple[int, int]]:
    """Stretches that the codec can write; a single character counts where its bytes are UTF-8."""
    out, a = [], 0
    for i in range(len(run) + 1):
        if i == len(run) or _byte_of(run[i], codec) is None:
            if i - a >= 2 or i > a and _is_utf8(_byte_of(run[a], codec)):
                out.append((a, i))
            a = i + 1
    return out


@lru_cache(maxsize=65536)
def _utf8_readings(chunk: str, least: float) -> tuple[tuple[int, str], ...]:
    """(number of the codec, chunk with UTF-8 sequences decoded) where that makes the chunk plausible.

    A chunk is text without ASCII white space; a blank at its end may stand for a no-break space within a sequence.
    """
    # A reading is left to another codec where that one's leads to a text better by more than a step costs.
    out = [(k, new, _lowest(new)) for k, new in _all_readings(chunk, least)]
    lowest = min((c for *_, c in out), default=0.0)
    return tuple((k, new) for k, new, c in out if c <= lowest + LESS)


@lru_cache(maxsize=65536)
def _all_readings(chunk: str, least: float) -> tuple[tuple[int, str], ...]:
    readings = [(k, _utf8_reading(chunk, codec, least)) for k, codec in enumerate(UTF8_READ_AS)]
    return tuple((k, new) for k, new in readings if new != chunk)


@lru_cache(maxsize=65536)
def _lowest(chunk: str) -> float:
    """The lowest cost that UTF-8 readings of a chunk, one after the other, lead to; each makes the chunk cheaper."""
    return min([cost(chunk), *(_lowest(new) for _, new in _all_readings(chunk, LESS))])


def _replaced(chunk: str, places: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in places:
        out += [chunk[at:a], new]
        at = b
    return "".join(out) + chunk[at:]


def _multi_byte_reading(chunk: str, codec: str, least: float) -> str:
    """As _utf8_reading. One accented letter is one character here, so the stretches of a chunk are judged together."""
    places = []
    before = cost(chunk)
    for m in _RUNS.finditer(chunk):
        run = m.group()
        for a, b in _writable(run.rstrip(" "), codec):
            new = b"".join(_byte_of(c, codec) for c in run[a:b]).decode("utf-8", "replace")
            place = (m.start() + a, m.start() + b, new)
            if before - cost(_replaced(chunk, [place])) >= LESS:
                places.append(place)
    new = _replaced(chunk, places)
    return new if places and before - cost(new) >= least else chunk


def _utf8_reading(chunk: str, codec: str, least: float) -> str:
    if codec in MULTI_BYTE:
        return _multi_byte_reading(chunk, codec, least)
    out, at = [], 0
    for m in _RUNS.finditer(chunk):
        run = m.group()
        raw = [_byte_of(c, codec) for c in run]
        if LOST in run:
            _fill(raw, run, codec)
        if run.endswith(" "):
            raw[-1] = b"\xa0" if len(run) > 1 and raw[-2] == b"\xc3" else None
        i = 0
        while i < len(raw):
            j, new, count = i, [], 0
            while j < len(raw) and (n := _sequence(raw, j)):
                new.append(b"".join(raw[j : j + n]).decode())
                j, count = j + n, count + 1
            if count:
                a, b = m.start() + i, m.start() + j
                text = "".join(new)
                gain = cost(chunk) - cost(chunk[:a] + text + chunk[b:])
                if gain >= least and gain >= 0.75 * count:
                    out += [chunk[at:a], text]
                    at = b
            i = max(j, i + 1)
    return "".join(out) + chunk[at:] if out else chunk


def _utf8_steps(text: str, least: float):
    """(codec, text) for every codec that UTF-8 in the text may have been read as."""
    chunks = []
    changed: dict[int, list[tuple[int, int, str]]] = {}
    for m in _CHUNKS.finditer(text):
        a, b = m.span()
        chunk = m.group()
        if not chunk[-1].isascii() and text[b : b + 1] == " ":
            chunk, b = chunk + " ", b + 1
        chunks.append((a, b, chunk))
        for k, new in _utf8_readings(chunk, least):
            changed.setdefault(k, []).append((a, b, new))
    for k, places in sorted(changed.items()):
        # Between damaged chunks, and to the ends of their lines, less is needed to believe in damage of this kind.
        low, high = text.rfind("\n", 0, places[0][0]), text.find("\n", places[-1][1])
        near = [(a, b, c) for a, b, c in chunks if low < a and (high < 0 or a < high)]
        places = [(a, b, new) for a, b, c in near for j, new in _utf8_readings(c, LESS) if j == k]
        out, at = [], 0
        for a, b, new in places:
            out += [text[at:a], new]
            at = b
        yield UTF8_READ_AS[k], "".join(out) + text[at:]


def _bad_before(words: list[str], gain: float, least: float, turned: bool) -> bool:
    """Whether words were bad enough to believe a gain; a change of script needs more letters to judge by."""
    before = sum(map(word_cost, words))
    cyrillic = any("а" <= c.lower() <= "я" for w in words for c in w)
    if gain < max(least + 1, (0.2 if cyrillic else 0.35) * before):
        return False
    if cyrillic:
        return True
    kinds = [kind(c) for w in words for c in w]
    if not any(k in "LHJ" for k, _ in kinds) and before < 1.5 + sum(c for _, c in kinds):
        return False  # symbols by themselves
    odd = sum(k not in "AP." for k, _ in kinds)
    return before >= 1.3 * odd and (odd >= 4 or not turned)


@lru_cache(maxsize=65536)
def _single_readings(word: str) -> dict[int, tuple[str, float]]:
    """Number of the pair of codecs: (word decoded anew, gain), where the word can have been read so."""
    out = {}
    for k, (read, written) in enumerate(SINGLE_BYTE):
        raw = [_byte_of(c, read) for c in word]
        if None not in raw:
            try:
                new = b"".join(raw).decode(written)
            except UnicodeDecodeError:
                continue
            out[k] = (new, word_cost(word) - word_cost(new))
    return out


def _single_steps(text: str, least: float):
    """(read, written, text) for every pair of codecs that makes some stretch of the text far better."""
    words = [(*m.span(), m.group(), _single_readings(m.group())) for m in _WORDS.finditer(text)]
    hopeful: dict[int, float] = {}
    for *_, readings in words:
        for k, (_, gain) in readings.items():
            if gain > 0:
                hopeful[k] = hopeful.get(k, 0.0) + gain
    for k in sorted(k for k, total in hopeful.items() if total >= least + 1):
        new = _single_places(text, words, k, least)
        if new is not None:
            yield *SINGLE_BYTE[k], new


def _single_places(text: str, words: list, k: int, least: float, slack: float = 3.0) -> str | None:
    """The text with stretches of words decoded anew; None if there is no such stretch.

    A stretch grows over words beyond ASCII while the sum of their gains stays within slack of its best; it ends
    where it was best. Words that cannot have been read so end it too.
    """
    out, at = [], 0
    stretch: list[tuple[int, int, str, str]] = []
    total = best = 0.0
    end = 0

    def close() -> None:
        nonlocal at
        kept = stretch[:end]
        turned = any(kind(c)[0] in "CHJ" for _, _, _, new in kept for c in new)
        hangul = [sum("가" <= c <= "힣" for c in new) for _, _, _, new in kept]
        if any(hangul) and sum(hangul) < 1.5 * sum(n > 0 for n in hangul):
            return  # syllables one by one are no Korean
        if kept and _bad_before([old for _, _, old, _ in kept], best, least, turned):
            for a, b, _, new in kept:
                out.extend((text[at:a], new))
                at = b

    for a, b, word, readings in words:
        new, gain = readings.get(k, (None, 0.0))
        if stretch and (new is None or total + gain < best - slack):
            close()
            stretch, total, best, end = [], 0.0, 0.0, 0
        if new is None or not stretch and gain <= 0:
            continue
        stretch.append((a, b, word, new))
        total += gain
        if total > best:
            best, end = total, len(stretch)
    if stretch:
        close()
    return "".join(out) + text[at:] if out else None


_AMPERSANDS = re.compile(r"&(?:(?:amp|#0*38|#[xX]0*26);)+")


def unescape(text: str) -> str:
    """Character references resolved, also those of references."""
    return html.unescape(_AMPERSANDS.sub("&", text)) if "&" in text else text


def price(text: str) -> float:
    """Cost of what a text stands for: references cost what their characters do, so that escaping hides no damage."""
    return cost(unescape(text))


def steps(text: str, least: float):
    """Neighbours of a text in the graph: (name, text)."""
    if "&" in text:
        yield "unescape", unescape(text)
    if not text.isascii():
        for codec, new in _utf8_steps(text, least):
            yield f"utf-8 read as {codec}", new
        for read, written, new in _single_steps(text, least):
            yield f"{written} read as {read}", new


@lru_cache(maxsize=65536)
def _excess(word: str) -> float:
    """Cost above what its letters and one odd neighbour account for; none where characters are lost for good."""
    if LOST in word:
        return 0.0
    return max(0.0, word_cost(word) - sum(min(kind(c)[1], 1.0) for c in word if not c.isascii()) - 1.0)


def _settled(text: str, words: set[str], least: float) -> bool:
    """Whether what is not among words is as plausible as its letters allow, to less than is evidence of damage."""
    return sum(_excess(w) for w in _words(unescape(text)) if w not in words) <= least


def _search(text: str, least: float, step_cost: float, states: int | None) -> tuple[str, str, float, float] | None:
    """(best text, its path, price before, price after), or None where more than `states` states would be expanded."""
    start = price(text)
    words = set(_words(unescape(text)))
    best, settled = (start, text, ""), False
    # Both forms of a text are searched from before any result can end the search.
    seeds = [text, unescape(text)] if "&" in text and unescape(text) != text else [text]
    seen, heap = set(seeds), [(start if i == 0 else start - step_cost, i, t, "unescape" if i else "", start) for i, t in enumerate(seeds)]
    heapq.heapify(heap)
    left = len(seeds)
    while heap:
        p, nth, now, path, own = heapq.heappop(heap)
        if p > best[0] and settled and not left:
            break
        left -= nth < len(seeds)
        if states is not None:
            states -= 1
            if states < 0:
                return None
        for name, new in steps(now, least):
            if new in seen:
                continue
            seen.add(new)
            c = price(new)
            if c >= own - step_cost and name != "unescape":
                continue
            to = f"{path} > {name}" if path else name
            p = c + step_cost * (to.count(">") + 1)
            if p < best[0]:
                best, settled = (p, new, to), _settled(new, words, least)
            heapq.heappush(heap, (p, len(seen) + 1, new, to, c))
    return best[1], best[2], start, price(best[1])


_LOST = re.compile(rf"[^\W_]{LOST}|{LOST}[^\W_]")


def _middle(text: str) -> int:
    """Where to part a text: after the line break, else the blank, nearest its middle; 0 where it has none."""
    half = len(text) // 2
    for sign in "\n ":
        at = max((i + 1 for i in (text.rfind(sign, 0, half), text.find(sign, half)) if 0 <= i < len(text) - 1), key=lambda i: -abs(i - half), default=0)
        if at:
            return at
    return 0


def restore(text: str, least: float = 2.5, step_cost: float = 0.5, states: int = 64) -> tuple[bool, str, str, float, float]:
    """(found, restored text, path, cost before, cost after) of one text.

    Best-first search: the cheapest open state is expanded next; a state counts its cost and step_cost for each step.
    A step must make the text cheaper by more than it costs, as every right one does, or resolve references; states
    dearer than the best are expanded as well, since the right first step of text damaged twice need not be the best
    one. The search ends when nothing is open. Texts damaged in so many independent ways that more than `states`
    states come up are parted near the middle, at a line break or blank, and each part is searched by itself: the
    ways of the parts no longer multiply, and a part without any blank is searched to its end whatever that takes.

    found: re-decodings lower the cost by at least `least`, references counted as the characters they stand for; or
    replacement characters stand at letters or digits, where the original is lost.
    """
    done: list[tuple[str, str, float, float]] = []
    parts, read = [text], []
    while parts:
        part = parts.pop()
        at = _middle(part)
        got = _search(part, least, step_cost, states if at else None)
        if got is None:
            parts += [part[at:], part[:at]]
        else:
            done.append(got)
            read.append(part)
    way: list[str] = []
    out, before, after = [], 0.0, 0.0
    for (new, path, b, a) in done:
        used = [s for s in path.split(" > ") if s]
        if not any(s != "unescape" for s in used):
            new, used, a = None, [], b
        way += [s for s in used if s not in way] if len(done) > 1 else used
        out.append(new)
        before, after = before + b, after + a
    gain = before - after
    lost = _LOST.search(text) is not None
    found = bool(way) and gain >= least or lost
    if not way:
        return lost, text, "", before, before
    return found, "".join(part if new is None else new for part, new in zip(read, out)), " > ".join(way), before, after


@lru_cache(maxsize=262144)
def _openings(word: str, least: float) -> tuple[bool, tuple[tuple[int, float], ...]]:
    """Whether UTF-8 readings alone open a step from this word, and what it adds to those of single bytes."""
    hot = bool(_utf8_readings(word, least)) or not word[-1].isascii() and bool(_utf8_readings(word + " ", least))
    return hot, tuple((k, gain) for k, (_, gain) in _single_readings(word).items() if gain > 0)


def has_steps(text: str, least: float = 2.5) -> bool:
    """False only where the search has no step to take and nothing is lost: it decides by the rules of the steps."""
    if "&" in text:
        text = unescape(text)
    if text.isascii():
        return False
    if LOST in text:
        return True
    sums: dict[int, float] = {}
    for w in _words(text):
        hot, gains = _openings(w, least)
        if hot:
            return True
        for k, gain in gains:
            sums[k] = sums.get(k, 0.0) + gain
    return any(total >= least + 1 for total in sums.values())


def _batches(least: float):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, known = [], {}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None or not has_steps(text, least):
                    rows.append((doc_id, False, text, "", 0.0, 0.0))
                    continue
                if text not in known:
                    known[text] = restore(text, least)
                rows.append((doc_id, *known[text]))
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ("doc_id", "found", "restored", "path", "cost_before", "cost_after")
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, types)], names=list(names))

    return run


def restore_texts(documents: DataFrame, least: float = 2.5) -> DataFrame:
    """doc_id, found, restored, path, cost_before, cost_after: one row per document (RESULT_SCHEMA).

    found: some of the text was decoded with the wrong encoding. restored is the text after the cheapest way of
    re-decodings, the text itself where none helps; null text stays null and is not found, nor is an empty one.
    Whole texts are searched, of any length; repeated rows are each answered. No shuffle: a scan with one Arrow step.
    """
    return spread(documents.select("doc_id", "text")).mapInArrow(_batches(least), RESULT_SCHEMA)
