"""Texts that were decoded with another encoding than they were written in.

Each character is mapped back to the byte that a legacy encoding has for it. An automaton over the bytes'
structure finds the maximal spans that are well-formed UTF-8 multibyte sequences; those spans, and only
those, are decoded. This is repeated until nothing changes, for text that was misread more than once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Set

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.cyrillic import decode_cyrillic
from cellweave.plans import spread

#: Legacy encodings that UTF-8 may have been read in, the likelier first; of those that explain equally much
#: of a text the first is taken.
ENCODINGS = ("cp1252", "iso8859_15", "cp1250", "iso8859_2", "cp1251", "mac_roman", "cp850", "cp437")
#: Times that a text may have been misread.
PASSES = 4

# Well-formed UTF-8 beyond ASCII, over characters that stand for bytes.
_SEQUENCE = "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
_SPANS = re.compile(f"(?:{_SEQUENCE})+")


class _Bytes(dict):
    """Translation of characters to characters that stand for their bytes; others to one that ends a span."""

    def __missing__(self, code: int) -> str:
        return chr(code) if code < 128 else "Ā"


def _legacy(encoding: str) -> tuple[_Bytes, re.Pattern]:
    """The translation of an encoding, and a pattern of two characters that a sequence may start with.
    Bytes without a character, and C1 controls, stand for themselves, as in the web's decoders."""
    table = _Bytes({c: chr(c) for c in range(0x80, 0xA0)})
    chars = {}
    for b in range(128, 256):
        try:
            chars[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            chars[b] = chr(b)
        table[ord(chars[b])] = chr(b)
    lead = "".join(re.escape(chars[b]) for b in range(0xC2, 0xF5))
    tail = "".join(re.escape(chars[b]) for b in range(0x80, 0xC0)) + "\x80-\x9f"
    return table, re.compile(f"[{lead}][{tail}]")


_TABLES = {e: _legacy(e) for e in ENCODINGS}

# Blocks of letters in most use: Latin with Extended-A, combining marks, Greek, Cyrillic without its historic
# part, Hebrew letters, Arabic, and all from Devanagari on. Two bytes of a legacy encoding easily spell another
# letter by chance, so one such sequence by itself counts only if it spells one of these, or if other spans of
# the text show its script.
_COMMON = ((0xA0, 0x17F), (0x192, 0x192), (0x218, 0x21B), (0x2C6, 0x2C7), (0x2DA, 0x2DC), (0x300, 0x36F), (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x5D0, 0x5EA), (0x60C, 0x655), (0x660, 0x66C), (0x67E, 0x6CC), (0x900, 0x10FFFF))


def _likely(char: str) -> bool:
    code = ord(char)
    if 0x80 <= code < 0xA0:  # between two misreadings
        return True
    return any(a <= code <= b for a, b in _COMMON) and unicodedata.category(char) not in ("Cn", "Co", "Cs", "Cc")


#: Letters of living Cyrillic alphabets that a one-byte encoding keeps apart from the main row.
_BEYOND = "ЁёІіЇїЄєҐґЎў"


def _is_char(char: str) -> bool:
    return 0x80 <= ord(char) < 0xA0 or unicodedata.category(char) not in ("Cn", "Co", "Cs", "Cc")


def _script(char: str) -> str:
    name = unicodedata.name(char, "")
    return "ARABIC" if "ARABIC" in name else name.partition(" ")[0]


def _coherent(decoded: str) -> bool:
    """Whether a span is evidence enough for letters of any block: several characters, the letters and
    digits of which are of one script, or a sequence of three bytes and more."""
    if not all(map(_is_char, decoded)):
        return False
    if len(decoded) == 1:
        return decoded > "\u07ff"
    return len({_script(c) for c in decoded if c.isalnum()}) == 1


def _shown(text: str, spans: list[tuple[re.Match, str]]) -> set[str]:
    """The scripts that other spans show: by several letters or sequences of three bytes, or, for Latin, by two
    small letters that stand behind others and aren't written with a punctuation mark."""
    if all(_likely(c) for _, decoded in spans for c in decoded):
        return set()
    scripts = {_script(c) for _, decoded in spans if _coherent(decoded) for c in decoded if c.isalnum()}
    within = sum(len(d) == 1 and d.islower() and _script(d) == "LATIN" and text[m.start() - 1 : m.start()].isascii() and text[m.start() - 1 : m.start()].islower() and unicodedata.category(text[m.start()])[0] != "P" for m, d in spans)
    return scripts | ({"LATIN"} if within > 1 else set())


def _accepted(text: str, start: int, end: int, decoded: str, shown: Set[str] = frozenset()) -> bool:
    if not all(map(_likely, decoded)) and not _coherent(decoded) and not (len(decoded) == 1 and decoded.isalnum() and _script(decoded) in shown):
        return False
    if len(decoded) == 1:
        written = text[start:end]
        before = text[max(0, start - 2) : start]
        # Capitals and a sign, as in a trade mark, not a small letter or an accent within capitals.
        if (decoded.islower() or unicodedata.combining(decoded)) and len(before) == 2 and before.isalpha() and before.isupper():
            return False
        # A Cyrillic capital before a letter from beyond the main row is a word's beginning, or capitals.
        beside = text[max(0, start - 1) : start] + text[end : end + 1]
        if written[1] in _BEYOND and "Ѐ" <= written[0] <= "џ" and not re.search("[A-Za-z]", beside) and (written[1].islower() or any("Ѐ" <= c <= "џ" and c.isupper() for c in beside)):
            return False
        if unicodedata.combining(decoded) and not before[-1:].isalpha():
            return False
    return True


def _decode_spans(text: str, encoding: str) -> tuple[str, int]:
    """text with the well-formed spans of an encoding decoded, and how many characters these had."""
    table, hint = _TABLES[encoding]
    if not hint.search(text):
        return text, 0
    out, at, covered = [], 0, 0
    spans = [(m, m.group().encode("latin-1").decode("utf-8")) for m in _SPANS.finditer(text.translate(table))]
    if not spans:
        return text, 0
    shown = _shown(text, spans)
    for m, decoded in spans:
        if _accepted(text, m.start(), m.end(), decoded, shown):
            out += [text[at : m.start()], decoded]
            at = m.end()
            covered += m.end() - m.start()
    return "".join([*out, text[at:]]), covered


# UTF-8 read as a Japanese double-byte encoding: kana begin with the bytes that spell these three characters.
_KANA_LEADS = re.compile("[縺繧繝]")
_WIDE = re.compile("[^\x00-\x7f]+")
_KANJI = re.compile("[一-鿿]")
_WIDE_SEQUENCE = re.compile(f"(?:{_SEQUENCE})".encode("latin-1"))


def _wide_pieces(run: str) -> Iterator[tuple[str, bytes | None]]:
    """The parts of a run with their bytes, None for those that the encoding doesn't hold."""
    try:
        yield run, run.encode("cp932")
    except UnicodeEncodeError as e:
        if e.start:
            yield run[: e.start], run[: e.start].encode("cp932")
        rest = run[e.start :]
        while True:
            n = next((i for i, c in enumerate(rest) if c.encode("cp932", "ignore")), len(rest))
            if n:
                yield rest[:n], None
            rest = rest[n:]
            try:
                if rest:
                    yield rest, rest.encode("cp932")
                return
            except UnicodeEncodeError as e:
                yield rest[: e.start], rest[: e.start].encode("cp932")
                rest = rest[e.start :]


def _wide_sequences(piece: str, raw: bytes) -> list[tuple[int, int, str]]:
    """The well-formed sequences of a part: where they lie and what they spell. Not those that spell no
    character, nor any if they are a small part of it. The bytes of kana that stand as written look like sequences
    of two, so these count only behind a longer one or from a half-width character on, of which one isn't enough."""
    at, narrow = 0, set()
    for c in piece:
        narrow |= {at} if "｡" <= c <= "ﾟ" else set()
        at += 1 if c <= "\x80" or "｡" <= c <= "ﾟ" else 2
    found, long = [], 0
    for s in _WIDE_SEQUENCE.finditer(raw):
        char = s.group().decode("utf-8")
        if unicodedata.category(char) in ("Cn", "Co", "Cs", "Cc"):
            continue
        if s.end() - s.start() == 2 and s.start() not in narrow and not (found and found[-1][1] == s.start()):
            continue
        long += s.end() - s.start() > 2
        found.append((s.start(), s.end(), char))
    covered = sum(end - start for start, end, _ in found)
    return found if covered * 3 >= len(raw) * (1 if long else 2) and (long or len(found) > 1) else []


def _is_wide(text: str) -> bool:
    """Whether a text holds UTF-8 read as cp932: leads of kana, or sequences of common kanji or kana that make
    up most of a part."""
    if len(_KANA_LEADS.findall(text)) >= 2:
        return True
    n = 0
    for m in _WIDE.finditer(text):
        for piece, raw in _wide_pieces(m.group()):
            found = _wide_sequences(piece, raw) if raw else []
            if raw and sum(end - start for start, end, _ in found) * 3 >= 2 * len(raw) - 2:  # but for a cut end
                # Kanji of the first level, kana and their signs have these leading bytes.
                n += sum(end - start == 3 and b"\x81" <= char.encode("cp932", "ignore")[:1] < b"\x99" for start, end, char in found)
    return n >= 2


def _decode_wide(text: str) -> tuple[str, int]:
    if not _KANJI.search(text) or not _is_wide(text):
        return text, 0
    covered = 0

    def one(m: re.Match) -> str:
        nonlocal covered
        parts = []
        for piece, raw in _wide_pieces(m.group()):
            found = _wide_sequences(piece, raw) if raw else []
            if not found:
                parts.append(piece)
                continue
            at = 0
            for start, end, char in found:
                parts += [raw[at:start].decode("cp932", "replace"), char]
                covered += end - start
                at = end
            parts.append(raw[at:].decode("cp932", "replace"))
        return "".join(parts)

    return _WIDE.sub(one, text), covered


# One-byte encodings read as Latin leave no byte structure: whole words of accented letters are Cyrillic,
# and signs within Latin words Polish.
_ACCENTED = re.compile("(?<![A-Za-z\xc0-\xff])[\xc0-\xff\xa8\xb8]{3,}(?![A-Za-z\xc0-\xff])")
_POLISH_STRONG = re.compile("(?<=[^\\W\\d_])[\xb3\xb9\xbf\xb6\xbc\xb1\xa5](?=[^\\W\\d_])|(?<![\\w.,])\xb3(?=[^\\W\\d_]{2})|(?<![A-Z])Ÿ(?=[a-z])|(?<=[^\\W\\d_])\xbf(?!\\w)")
_POLISH_WEAK = re.compile("(?<=[^\\W\\d_m])[\xb3\xb9\xb1](?!\\w)")  # m\xb3 is a unit
_POLISH = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"


def _decode_russian(text: str) -> tuple[str, str | None]:
    words = _ACCENTED.findall(text)
    letters = sum(len(w) for w in words)
    if letters >= 4 and letters > max(_decode_spans(text, e)[1] for e in ENCODINGS) and any(sum(c.isalpha() for c in w) >= 3 for w in words):
        def russian(encoding: str) -> int:
            read = "".join(words).encode("latin-1").decode(encoding, "replace")
            return sum(c in "оеаинтсрвл" for c in read)

        best = max(("cp1251", "koi8_r", "iso8859_5"), key=russian)

        def word(m: re.Match) -> str:
            try:
                return m.group().encode("cp1252").decode(best)
            except UnicodeError:
                return m.group()

        return re.sub("[\x80-\xff‘-„…€]*[\xc0-\xff\xa8\xb8][\x80-\xff]*", word, text), best
    return text, None


def _decode_polish(text: str) -> tuple[str, str | None]:
    strong, weak = _POLISH_STRONG.findall(text), _POLISH_WEAK.findall(text)
    if strong or weak:
        latin2 = sum(c in "\xb6\xbc\xb1" for c in strong + weak) > sum(c in "\xb9\xa5Ÿ\x9cœ" for c in strong + weak)
        encoding = "iso8859_2" if latin2 else "cp1250"

        def letter(m: re.Match) -> str:
            try:
                read = m.group().encode("cp1252").decode(encoding)
            except UnicodeError:
                return m.group()
            return read if read in _POLISH else m.group()

        return re.sub("[^\x00-\x7f]", letter, text), encoding
    return text, None


# An a with grave accent whose second byte, a no-break space, became a common space.
_SPACED = re.compile("(?:(?<=[a-z])|(?<!\\w))Ã (?: ?(?P<word>(?=[a-z]))|(?=[^\\w ]))")

# Sequences of windows-1252 that lost a byte without a character: quotes, ligatures and signs beyond the
# basic plane of which the rest still stands.
_TORN = re.compile("â€(?![\\w\x80-\xbf])|ï[¬»](?![\x80-\xbf])|ðŸ|ð[“”][\x80-\xbf‚„…†‡ˆ‰‹‘-”•–—˜™›]")


def repaired(text: str) -> tuple[str, list[str], bool]:
    """The text as it was written as far as it can be known, the encodings it was misread in, in the order
    of repair, and whether characters of it are lost for good."""
    lost = "�" in text
    steps: list[str] = []
    if text.isascii():
        return text, steps, lost
    text, name = _decode_russian(text)
    if name:
        steps.append(name)
    new, letters, name = decode_cyrillic(text)
    if name and letters > max(_decode_spans(text, e)[1] for e in ENCODINGS):
        text = new
        steps.append(name)
    seen = text if not name else None  # nothing in it
    for _ in range(PASSES * 2):  # parts of a text may differ
        best, gain = None, 0
        for e in ENCODINGS:
            new, covered = _decode_spans(text, e)
            if covered > gain:
                best, gain, name = new, covered, e
        wide, covered = _decode_wide(text) if "cp932" not in steps else (text, 0)
        if covered > gain:
            best, gain, name = wide, covered, "cp932"
        if best is None or best == text:
            break
        text = best
        steps.append(name)
    text, _, name = decode_cyrillic(text) if text != seen else (text, 0, None)
    if name:
        steps.append(name)
    whole = _SPACED.sub(lambda m: "à" if m["word"] is None else "à ", text)
    if whole != text:
        text = whole
        steps += [] if "cp1252" in steps else ["cp1252"]
    text, name = _decode_polish(text)
    if name:
        steps.append(name)
    lost = lost or bool(_TORN.search(text))
    return text, steps, lost


def _repair(column: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(column).to_pylist()
            made = [repaired(t) if t else (t, [], False) for t in texts]
            rest = [c for c in b.schema.names if c != column]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in rest), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string())), pa.array([m[2] for m in made], pa.bool_())],
                names=[*rest, column, "misread_as", "lost"],
            )

    return run


def repaired_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the text as restored, ``misread_as`` (the encodings undone, in order) and ``lost`` (whether
    it holds replacement characters or torn sequences, so that some of it is lost for good), for each row of docs.
    Cyrillic text that was read in another Cyrillic encoding is given as the written one, a stroke and the read one.

    A row is damaged if ``misread_as`` isn't empty or ``lost`` is true; the text of other rows is unchanged.
    Null and empty texts are undamaged. Texts are repaired where they are read, only an input of fewer
    splits than cores being spread first, and only those beyond ASCII are sent through the automaton.
    """
    if {"misread_as", "lost", text} & set(keep):
        raise ValueError("keep holds the text or a column of the result")
    docs = spread(docs.select(*keep, text), *keep)
    plain = F.col(text).isNull() | ~F.col(text).rlike("[^\\x00-\\x7f]")
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField(text, T.StringType()), T.StructField("misread_as", T.ArrayType(T.StringType())), T.StructField("lost", T.BooleanType())])
    wide = docs.filter(~plain).select(*keep, text).mapInArrow(_repair(text), schema)
    ascii_ = docs.filter(plain).select(*keep, text, F.array().cast("array<string>").alias("misread_as"), F.lit(False).alias("lost"))
    return wide.unionByName(ascii_)


def damage_report(repairs: DataFrame) -> DataFrame:
    """(misread_as, n_rows, n_lost): how often each chain of encodings was undone."""
    return repairs.filter("lost OR size(misread_as) > 0").groupBy(F.array_join("misread_as", " ").alias("misread_as")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("lost").cast("bigint")).alias("n_lost"))
