"""Tokens, packing and encoding repair."""

import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.llm.cyrillic import ENCODINGS as CYRILLIC
from cellweave.llm.encoding import damage_report, repaired, repaired_texts
from cellweave.llm.packing import pack, packed_containers
from cellweave.llm.tokens import PATTERN, TOKENIZERS, MergeReplay, _Task, encode_corpus, load_ranks

RANKS = load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
REPLAY = MergeReplay(RANKS)
ODD = ["", None, " ", "\n\n  x", "a" * 5000, "ab" * 900, "aaa aaab", "I'll 'S don't", "<|endoftext|>", "日本語のテキスト" * 300, "é" * 50, "👩‍🔧🇵🇹", "\x00\x80﻿", "x" * 200_000]


def ids_of(texts):
    ids, counts = _Task(REPLAY).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_odd_texts_match_the_public_tokenizer():
    assert ids_of(ODD) == [PUBLIC.encode_ordinary(t) if t else [] for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab 'sS1é", max_size=60)), max_size=8))
def test_any_texts_match_the_public_tokenizer(texts):
    if texts:
        assert ids_of(texts) == [PUBLIC.encode_ordinary(t) if t else [] for t in texts]


def test_replay_of_bytes_round_trips():
    r = random.Random(1)
    words = [bytes(r.randrange(256) for _ in range(r.randrange(40))) for _ in range(200)]
    back = {i: t for t, i in RANKS.items()}
    assert [b"".join(back[i] for i in ids) for ids in REPLAY.encode(words)] == words
    assert all(base64.b64encode(w) is not None for w in words) and REPLAY.encode([]) == []


def test_forgetting_words(monkeypatch):
    import cellweave.llm.tokens as M

    monkeypatch.setattr(M, "KEPT_WORDS", 3)
    monkeypatch.setattr(M, "REPLAYED", 5)
    task = _Task(REPLAY)
    for texts in (["one two three four"], ["four five", "one"], ["two"]):
        ids, counts = task.encode(texts)
        assert ids.tolist() == [i for t in texts for i in PUBLIC.encode_ordinary(t)]


def test_corpus(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_corpus(docs).collect()}
    assert got == {i: PUBLIC.encode_ordinary(t) if t else [] for i, t, _ in rows}
    assert {r.doc_id: r.n_tokens for r in encode_corpus(docs, counts_only=True).collect()} == {i: len(v) for i, v in got.items()}
    assert encode_corpus(docs.limit(0)).count() == 0


def check_packing(rows, sizes, capacity, segments):
    placed = [r for r in rows if r.container_id is not None]
    per = {}
    for r in placed:
        per.setdefault(r.container_id, []).append(r)
    for own in per.values():
        assert sum(r.n_tokens for r in own) <= capacity and len(own) <= segments
        own.sort(key=lambda r: r.container_offset)
        assert own[0].container_offset == 0 and all(a.container_offset + a.n_tokens == b.container_offset for a, b in zip(own, own[1:]))
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == sizes.keys()
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        n = sizes[d] or 0
        assert sum(r.n_tokens for r in own) == n and [r.token_start for r in own] == [i * capacity for i in range(len(own))]
        assert len(own) == max(1, -(-n // capacity)) and (n > 0 or own[0].container_id is None)
    return len(per)


@pytest.mark.parametrize("chunk_items", [50_000, 400])
def test_packing(spark, chunk_items):
    r = random.Random(2)
    sizes = {i: min(9000, int(r.lognormvariate(4.3, 1.2))) for i in range(3000)} | {3000: None, 3001: 0, 3002: 2048, 3003: 4096, 3004: 1}
    items = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint").withColumn("chunk", F.lit(1)).withColumn("item", F.lit(1))
    out = packed_containers(items, chunk_items=chunk_items)
    rows = out.collect()
    used = check_packing(rows, sizes, 2048, 1024)
    assert used <= -(-sum(x or 0 for x in sizes.values()) // 2048) + 2
    again = packed_containers(items.repartition(5), chunk_items=chunk_items).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_packing_limits(spark):
    items = spark.createDataFrame([(i, 10, 3) for i in range(100)], "doc_id bigint, n_tokens bigint, l bigint")
    assert packed_containers(items, capacity=100, max_segments=4).select("container_id").distinct().count() == 25
    assert packed_containers(items, loss="l", capacity=100, max_loss=9).select("container_id").distinct().count() == 34
    assert packed_containers(items.limit(0)).count() == 0


def test_packing_splits_only_what_does_not_fit(spark):
    """An item within both limits stays whole; others are cut no more than the limits ask for."""
    items = spark.createDataFrame([*((i, 10, 3) for i in range(100)), (200, 250, 4), (201, 30, 20), (202, 120, 9), (203, 100, 10), (204, 18, 18), (205, 0, 0)], "doc_id bigint, n_tokens bigint, l bigint")
    rows = packed_containers(items, loss="l", capacity=100, max_loss=9).collect()
    pieces, loss, used = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        pieces.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
    assert all(pieces[i] == [(0, 10)] for i in range(100))
    assert pieces[200] == [(0, 100), (100, 100), (200, 50)] and pieces[201] == [(0, 9), (9, 9), (18, 12)]
    assert pieces[202] == [(0, 100), (100, 20)] and pieces[203] == [(0, 9), (9, 91)] and pieces[204] == [(0, 9), (9, 9)] and pieces[205] == [(0, 0)]
    borne = {r.doc_id: r.l for r in items.collect()}
    for r in rows:
        if r.container_id is not None:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
            loss[r.container_id] = loss.get(r.container_id, 0) + max(0, min(r.n_tokens, borne[r.doc_id] - r.token_start))
    assert max(used.values()) <= 100 and max(loss.values()) <= 9


def test_pack_mixes_demands():
    """Items heavy in tokens go with items heavy in loss tokens."""
    tokens, loss = np.array([90] * 10 + [10] * 10), np.array([10] * 10 + [10] * 10)
    where, offset = pack(tokens, loss, (100, 10, 20))
    assert where.max() + 1 == 10 and offset.max() <= 90


CLEAN = ["Le goût du café s’intègre bien à côté du réfrigérateur.", "Größe und Mängel: süßlich, „schön“ – 3 €", "Não sei, é uma decepção. NÃO É MAÇÃ", "Серийный номер не работает как часы.", "W małej łazience, dźwięk się nie nadaje; żółć"]


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp850", "cp437"])
def test_misread_once(text, encoding):
    try:
        bad = text.encode().decode(encoding)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode())
    got, steps, lost = repaired(bad)
    assert got == text and steps and not lost


@pytest.mark.parametrize("text", CLEAN[:3])
def test_misread_more_than_once_and_in_part(text):
    twice = text.encode().decode("latin-1").encode().decode("latin-1")
    thrice = twice.encode().decode("latin-1")
    assert repaired(twice)[0] == repaired(thrice)[0] == text
    mixed = text + " … " + text.encode().decode("latin-1")
    assert repaired(mixed)[0] == text + " … " + text


def test_one_byte_encodings():
    assert repaired("Сборка: 4 винта".encode("cp1251").decode("latin-1")) == ("Сборка: 4 винта", ["cp1251"], False)
    assert repaired("W małej łazience, pokrętło".encode("cp1250").decode("cp1252"))[0] == "W małej łazience, pokrętło"
    assert repaired("Gr��e 52")[2] and not repaired("Gr��e 52")[1]
    wide = "箱を開けた瞬間、とても使いやすいです。".encode()
    assert repaired(wide.decode("cp932", "replace"))[1] == ["cp932"]


@pytest.mark.parametrize(
    "text",
    [*CLEAN, "IRMÃ® und MAÇÃ", "x²≥4 √2 ≈ 1,41 ± 5 % ¾ (½)", "Menu: ├── Töne └── Übrigens", "Ð og Þ eru á lyklaborðinu, Þór", "ボタンがｶﾁｯと鳴る。", "4.º ¿Alguien? ¡olé! «Ñandú»", "𝓯𝓪𝓷𝓬𝔂 ﬁne ﷽ 👩‍🔧 🇵🇹 soft\xadhyphen", "10 m³, 5 m²", "CHÂTEAU ÎLE ÂGE", "מה שלום مرحبا अच्छा ดีมาก καλό 좋아요", "Ёлка, Рёбра, ТРЁХ", "été ã"],
)
def test_undamaged_texts_stay(text):
    assert repaired(text) == (text, [], False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_repair_never_fails(text):
    new, steps, lost = repaired(text)
    assert isinstance(new, str) and (steps or new == text) and (lost or "�" not in text)


@pytest.mark.parametrize("written", CYRILLIC)
@pytest.mark.parametrize("read", CYRILLIC)
def test_cyrillic_read_as_cyrillic(written, read):
    """Wholly and in part; runs of another script and signs among them stay or come along."""
    def bad(text):
        return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode(written))

    if written == read:
        return
    for text in ("Продавец ответил на второй день, спасибо", "Доставка заняла 35 дней. Советую"):
        assert repaired(bad(text)) == (text, [f"{written}/{read}"], False)
        assert repaired("Le goût du café: " + bad(text) + "! Ткань приятно удивляет.")[0] == "Le goût du café: " + text + "! Ткань приятно удивляет."


def test_little_misread_cyrillic():
    assert repaired("чЕТОХМЙ") == ("Вернули", ["koi8_r/cp1251"], False)
    assert repaired("кнопка ЧЩЗМСДЙФ МХЮЫЕ, ЮЕН ОБ ЖПФП. xќ™4")[0] == "кнопка выглядит лучше, чем на фото. x²≥4"
    for whole in ("пРИВЕТ, эТО оЧЕНЬ пЛОХОЙ тОВАР", "УЖАСНО! НЕ ПОКУПАЙТЕ, ГОСТ СССР ФСБ", "ЦЕ ДУЖЕ ПОГАНИЙ ТОВАР, Їжак і ґанок", "Љубав је лепа, ЏЕМПЕР И ЊЕГОШ", "Қазақша ӘЛЕМ жақсы", "│ да │ ├── нет └── Töne", "15 µm soft\xadhyphen и √2 ≈ 1,41", "НЕ РАБОТИ ДОБРЕ, ЪГЪЛ"):
        assert repaired(whole) == (whole, [], False)


def test_wide_runs_and_kanji():
    """Every run of a text that was misread is decoded, and kanji are evidence too."""
    bad = "製造番号はPHOT87-79。店の返事は5日後でした。".encode().decode("cp932", "replace")
    text, steps, lost = repaired(bad)
    assert steps == ["cp932"] and lost and "番号はPHOT87-79" in text and text.startswith("製") and "店" in text and "返事" in text
    assert repaired("番号".encode().decode("cp932")) == ("番号", ["cp932"], False)
    assert repaired("Modell X5 番号 👍".encode().decode("cp932", "replace").split("�")[0])[0].startswith("Modell X5 番号")
    assert "番号👍番号" in repaired("番号👍番号".replace("番号", "番号".encode().decode("cp932")))[0]
    part = "Phobeltam-799は使い物になりません。"
    assert repaired("とても使いやすい".encode().decode("cp932", "replace") + " " + part)[0].endswith(part)
    for whole in ("縺れる糸、髙橋さんの綺麗な鞄。ﾅｲﾌとﾃﾞｻﾞｲﾝ", "製造番号は薔薇87", "憂鬱な顰蹙、麒麟の鬣", "質量輕巧,顏色鮮豔,纖維縫製"):
        assert repaired(whole) == (whole, [], False)


@pytest.mark.parametrize("text", ["hương", "Đã nhận được hàng, rất tư", "Dəri çox yaxşı, əla", "Қазақша әлем", "Բարև ձեզ", "ہے یہ اچھا", "قیمت ۱۲۳", "ǎ nǐ hǎo", "ܫܠܡܐ", "߁ ߂ߏߞߏ"])
@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp1251"])
def test_letters_of_any_block(text, encoding):
    bad = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode())
    got, steps, lost = repaired(bad)
    assert got == text and steps and not lost


@pytest.mark.parametrize("text", ["L’écran m’a déçu, l’été", "Le «été», une «école» «à» lui", "mais…être, et…être", "CAFÉ», THÉ»", "Цена 5 ЗЋ"])
def test_chance_sequences_stay(text):
    assert repaired(text) == (text, [], False)
    assert repaired(text + " dÃ©Ã§u dÃ©Ã§u dÃ©Ã§u")[0] == text + " déçu déçu déçu"


def test_repaired_rows(spark):
    rows = [(1, "plain", 0), (2, "cafÃ©", 0), (3, None, 0), (4, "", 0), (5, "Gr�", 0), (6, "cafÃ© " * 50_000, 0)]
    out = repaired_texts(spark.createDataFrame(rows, "doc_id bigint, text string, lost int"))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 6 and [d for d, r in got.items() if r.lost or r.misread_as] and got[6].text == "café " * 50_000
    assert sorted(d for d, r in got.items() if r.lost or r.misread_as) == [2, 5, 6] and got[3].text is None
    assert sorted(map(tuple, damage_report(out).collect())) == [("", 1, 1), ("cp1252", 2, 0)]


def test_lost_bytes_and_spaces():
    assert repaired("Il est dÃ©jÃ  lÃ .") == ("Il est déjà là.", ["cp1252"], False)
    assert repaired("Ã la maison")[0] == "à la maison" and repaired("et Ã  la maison") == ("et à la maison", ["cp1252"], False)
    for torn in ("said â€", "ï¬ne", "ok ðŸ‘", "ð“¯ð“ª"):
        assert repaired(torn)[2]
    assert not repaired("„orð“ og „borð”")[2]
    assert repaired("Em quêção éçã compara\xe7\xe3o")[1] == []


def test_names_of_results_are_refused(spark):
    df = spark.createDataFrame([(1, "a", 2)], "ids int, text string, lost int")
    for call in (lambda: encode_corpus(df, keep=("ids",)), lambda: repaired_texts(df, keep=("lost",)), lambda: packed_containers(df.withColumnRenamed("ids", "piece"), item="piece", tokens="lost")):
        with pytest.raises(ValueError):
            call()
