"""Cyrillic text in a one-byte encoding that was read in another one.

Such text stays Cyrillic, or letters with signs and lines, and has no byte structure. A path through the runs
of characters beyond ASCII tells which were misread: each run is as it stands or misread, and every change
between the two costs. A run is judged by how likely its letters, their pairs and their case are.
"""

from __future__ import annotations

import re
from itertools import permutations
from math import log

#: Encodings of which each may have been read as each other.
ENCODINGS = ("cp1251", "koi8_r", "cp866", "iso8859_5")

# Letters in a thousand of Russian (the hard sign as often as Bulgarian, where it is a vowel, leaves room for), and its commonest pairs.
_PER_MILLE = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 4, 4), strict=True))
_LETTERS = {c: log(n / 1000) for c, n in _PER_MILLE.items()} | dict.fromkeys("іїєґў", -5.0)
_PAIRS = frozenset("ст но то на ен ов ни ра во ко ро ол от ос ор ре пр по го ка ал не ли ва ер ет ан ть ло ла ом ат та ин он те ел ив ес од ри де за ие ия ый ой ая ся ит ле ль ис ны за че ем ми мо об вы до пе ма да ки ме ку бы ру ви ты дн ач ас чт тр аз жн ел ам ве ев ну ул".split())
_VOWELS = frozenset("аеиоуыэюяё")
_NO_CONSONANT = _VOWELS | set("йьъ")
_HIATUS = frozenset("ая ое ее ие ия ии ые ою ую юю яя ею ео еи ои оя аю уе ау".split())
# Signs that stand beside words, other Cyrillic letters, and all else.
_SIGN, _OTHER_LETTER, _ODD = -4.0, -7.0, -7.0
_SIGNS = frozenset("\xa0«»„“”‘’–—…№°²³•™®©€±")
# What a common pair is worth; what a rare pair of vowels costs, a capital after a small letter, each capital
# after the first, and a soft or hard sign or a short i in a place where it can't stand.
_PAIR, _RARE, _INVERTED, _CAPITAL, _SOFT = 1.0, -1.5, -5.0, -0.3, -4.0
# What it costs to begin and to end a stretch, and the least that words of a text must show by letters alone.
_BEGIN, _END, _LEAST, _LEAST_LETTERS = 5.0, 2.5, 3.0, 4
#: Runs whose judgement a task keeps, for each pair.
_KNOWN = 20_000
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_WITHIN = re.compile("(?<=[А-яЁё])[\xa0№°²³•™®©€±]+(?=[А-яЁё])")
_WORD = re.compile("[\xa0«„“(]*(?:(?:[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+)(?:[\xa0»”“,.:;…–—-]+|$))+")
_LINE = re.compile("([^Ѐ-ӿ])\\1(?:\\1|.*\\1\\1)")
_MAYBE = re.compile("[Ѐ-џ─-▟]")


def _letters(run: str) -> float:
    """Log likelihood of the letters and signs, without case."""
    total, before = 0.0, ""
    for c in run.lower():
        total += _LETTERS.get(c) or (_SIGN if c in _SIGNS else _OTHER_LETTER if "Ѐ" <= c <= "ӿ" else _ODD)
        total += (before + c in _PAIRS) * _PAIR
        total += (c in _VOWELS and before in _VOWELS and before + c not in _HIATUS) * _RARE
        total += (c == "ь" and not before or c in "ьъ" and before in _NO_CONSONANT) * _SOFT
        total += (c == "й" and "а" <= before <= "я" and before not in _VOWELS) * _SOFT
        before = c
    if len(run) == 1 and before not in "вискуоая":  # words of one letter
        total += _SOFT
    return total + len(_WITHIN.findall(run)) * (_ODD - _SIGN)


def _case(run: str) -> float:
    inverted = any(a.islower() and b.isupper() for a, b in zip(run, run[1:]))
    return inverted * _INVERTED + sum(c.isupper() for c in run[1:]) * _CAPITAL


class _Pair:
    """An encoding read as another one."""

    def __init__(self, written: str, read: str):
        self.name = f"{written}/{read}"
        self.table = {}
        for b in range(128, 256):
            try:
                self.table[ord(bytes([b]).decode(read))] = bytes([b]).decode(written)
            except UnicodeDecodeError:
                continue
        self.runs = re.compile("[" + "".join(re.escape(chr(c)) for c in self.table) + "]+")
        self.known: dict[str, tuple[str, float, float, int]] = {}

    def judged(self, run: str) -> tuple[str, float, float, int]:
        if (known := self.known.get(run)) is None:
            known = self._judged(run)
            if len(run) <= 40:
                if len(self.known) >= _KNOWN:
                    self.known.clear()
                self.known[run] = known
        return known

    def _judged(self, run: str) -> tuple[str, float, float, int]:
        """The run as it was written, the evidence of its letters and of its case that it was misread, and how
        many letters it has, if it is a word as written and, as it stands, holds letters or several signs."""
        made = run.translate(self.table)
        letters = _letters(made) - _letters(run)
        n = len(_CYRILLIC.findall(made))
        if not n:  # signs alone say nothing
            return made, min(0.0, letters), 0.0, 0
        word = _WORD.fullmatch(made) and _VOWELS & set(made.lower()) and (len(_CYRILLIC.findall(run)) >= 2 or len(set(run)) >= 3) and not _LINE.search(run)
        return made, letters, _case(made) - _case(run), n if word else 0

    def stretches(self, text: str) -> tuple[float, int, str]:
        """Evidence by the likeliest path, the letters of words it takes for misread, and the text so restored."""
        runs = list(self.runs.finditer(text))
        judged = []
        for m in runs:
            made, letters, case, n = self.judged(m.group())
            beside = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
            if any(map(str.isalpha, beside)) and _CYRILLIC.search(made):  # a letter or sign of another script's word
                letters, case, n = -_BEGIN, 0.0, 0
            judged.append((made, letters, case, n))
        if not any(n and a + b > 0 for _, a, b, n in judged):
            return 0.0, 0, text
        stands, misread, back = 0.0, -_BEGIN, []
        for _, a, b, _ in judged:
            back.append((misread - _END > stands, stands - _BEGIN > misread))
            stands, misread = max(stands, misread - _END), max(misread, stands - _BEGIN) + a + b
        state, taken = misread > stands, []
        gain = max(stands, misread)
        for k in range(len(runs) - 1, -1, -1):
            if state:
                taken.append(k)
            state = not back[k][1] if state else back[k][0]
        taken.reverse()
        words = [judged[k] for k in taken if judged[k][3]]
        if sum(a for _, a, _, _ in words) < _LEAST or sum(n for *_, n in words) < _LEAST_LETTERS:
            return 0.0, 0, text
        out, at = [], 0
        for k in taken:
            out += [text[at : runs[k].start()], judged[k][0]]
            at = runs[k].end()
        return gain, sum(n for *_, n in words), "".join([*out, text[at:]])


_ALL = [_Pair(w, r) for w, r in permutations(ENCODINGS, 2)]
_RUNS = re.compile("[^\x00-\x7f]+")
_plain: set[str] = set()


def _is_plain(run: str) -> bool:
    """Whether no pair finds evidence in the run, which most words of a text have been asked before."""
    if run in _plain:
        return True
    for pair in _ALL:
        for part in pair.runs.findall(run):
            _, letters, case, n = pair.judged(part)
            if n and letters + case > 0:
                return False
    if len(run) <= 40:
        if len(_plain) >= _KNOWN:
            _plain.clear()
        _plain.add(run)
    return True


def decode_cyrillic(text: str) -> tuple[str, int, str | None]:
    """The text with its misread stretches restored, how many letters their words had, and the pair of
    encodings, the written one first; None if no stretch was misread."""
    if not _MAYBE.search(text) or all(map(_is_plain, _RUNS.findall(text))):
        return text, 0, None
    best, name = (0.0, 0, text), None
    for pair in _ALL:
        found = pair.stretches(text)
        if found[0] > best[0]:
            best, name = found, pair.name
    return best[2], best[1], name
