import os
from collections import Counter

import numpy as np
import pytest

from scarpline.llm import garbled as G
from scarpline.llm.encode import BYTE_BPE, TOKENIZERS, MergeReplay, token_ids
from scarpline.llm.packing import pack_texts

PATH = os.path.join(TOKENIZERS, BYTE_BPE)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")
STRANGE = [
    None, "", " ", "\n\n \t  x", "a" * 5000, "aaa aaaa aaaaa", "<|endoftext|> plain", "naïve café — “quoted” 12.5 m³/s", "नाप अनुसार दाग", "⛰️🚧👷🏽‍♀️", "é ​﻿", "don't we'll I'M", "x" + " " * 3000 + "y", "٣٤ ½ ²", "\x00\x01", "𝔘𝔫𝔦", "def f(x):\n    return x\n" * 50,
]


def test_same_ids_as_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    rng = np.random.default_rng(1)
    alphabet = list("abcdefgh ABC 0123 .,;'\n\téñ—नाПр🚧")
    texts = STRANGE + ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 400, 200)] * 2
    want = [None if x is None else t.encode(x, add_special_tokens=False).ids for x in texts]
    d = spark.createDataFrame([(k, x, "y") for k, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in token_ids(d).collect()}
    assert got == dict(enumerate(want)) and token_ids(d.limit(0)).count() == 0


def test_the_worker_forgets_and_goes_on(monkeypatch):
    import scarpline.llm.encode as E

    monkeypatch.setattr(E, "KEPT_WORDS", 3)
    m = MergeReplay(PATH)
    a = [m.encode([x])[1].tolist() for x in STRANGE if x]
    b = [m.encode([x])[1].tolist() for x in STRANGE if x]
    assert a == b


@pytest.mark.parametrize("shard", [20_000, 60])
def test_packing(spark, shard):
    rng = np.random.default_rng(2)
    vocabulary = [f" word{k}" for k in range(300)] + [" the", " dam", " of", " scar"] * 20
    texts = ["".join(rng.choice(vocabulary, int(n))) for n in rng.gamma(1.0, 60, 400)] + ["".join(rng.choice(vocabulary, 4000)), None, "", "x", "x", " "]
    d = spark.createDataFrame([(k, x, 1, "c") for k, x in enumerate(texts)], "doc_id long, text string, shard int, container string")
    rows = pack_texts(d, capacity=256, shard=shard).collect()
    m = MergeReplay(PATH)
    length = {k: len(m.encode([x])[1]) for k, x in enumerate(texts) if x}
    fill, pieces = Counter(), {}
    for r in rows:
        fill[r.container_id] += r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
    assert set(pieces) == set(length) and max(fill.values()) <= 256
    for k, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and [f for _, f, _ in own] == [256 * p for p, _, _ in own] and sum(n for *_, n in own) == length[k]
        assert len(own) == 1 or length[k] > 256
    assert len(fill) <= -(-sum(length.values()) // 256) + (1 if shard > 1000 else 4)
    places = Counter((r.container_id, r.place) for r in rows)
    assert max(places.values()) == 1
    assert pack_texts(d.limit(0)).count() == 0


CLEAN = [
    "The contractor’s fence at Börde stands — “safe for now” at 12° in the café.", "La rivière s’est élevée près de la levée ; l’équipe a noté 12 m² à l’aube.", "Die Böschung müsste täglich geprüft werden, heißt es im Gerölltal.",
    "¿Quién midió la grieta? El señor de la caseta oyó piedras; según él, habrá inspección aérea mañana.", "Přinesla větší kameny až k lávce, použijte jiný snímek.", "Склон осматривали вчера, новых трещин не нашли. Снова тихо.",
    "गोठालाले डाँडापछाडि पुरानो दाग देखायो। हिलोको बाँधले पानी थुनेको छ।", "plain ascii text, nothing else", "N·m⁻², σ′ = 14 kPa, φ ≈ 16° ±83 µm, §3, ¼ turn", "┌────┬────┐\n│ ab │ cd │\n└────┴────┘", "Ã-axis / Â-axis offset", "&eacute; %C3%A9 \\u00e9",
    "no break spaces and​ zero width", "СКЛОН ОСМАТРИВАЛИ ВЧЕРА, НОВЫХ ТРЕЩИН НЕ НАШЛИ.", "ÉTAT : RIVE ÂPRE, ACCÈS FERMÉ À L’AUBE", "étude cöordinate", "⛰️🚧👷🏽‍♀️ ✅",
]


def damaged(text, written, read):
    return text.encode(written).decode(read)


def latin(b):
    """Reads cp1252 as most programs do: open bytes pass through."""
    return "".join(bytes([x]).decode("cp1252") if x not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(x) for x in b)


BAD = [
    (latin(CLEAN[0].encode()), CLEAN[0]), (damaged(CLEAN[0], "utf-8", "latin-1"), CLEAN[0]), (latin(latin(CLEAN[0].encode()).encode("utf-8")), CLEAN[0]), (damaged(CLEAN[1], "utf-8", "mac_roman"), CLEAN[1]), (damaged(CLEAN[2], "utf-8", "cp437"), CLEAN[2]),
    (damaged(CLEAN[3], "cp1252", "mac_roman"), CLEAN[3]), (damaged(CLEAN[3], "cp1252", "cp1251"), CLEAN[3]), (damaged(CLEAN[5], "cp1251", "latin-1"), CLEAN[5]), (damaged(CLEAN[2], "utf-8", "koi8-r"), CLEAN[2]),
    ("Fine here, but at the damâ€™s face not: " + CLEAN[0], "Fine here, but at the dam’s face not: " + CLEAN[0]), ("A caf� hut", "A caf� hut"), (latin(CLEAN[5].encode()), CLEAN[5]),
]


def test_garbled_round_trip(spark):
    rows = [t for t in CLEAN for _ in range(40)]
    texts = rows + [b for b, _ in BAD] + [None, "", BAD[0][0]]
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {r.doc_id: r for r in G.garbled(d).collect()}
    assert set(got) == {*range(len(rows), len(rows) + len(BAD)), len(texts) - 1}
    for k, (_, clean) in enumerate(BAD):
        assert got[len(rows) + k].restored == clean
        assert got[len(rows) + k].complete == ("�" not in clean)
    assert G.garbled(d.limit(0)).count() == 0


@pytest.mark.parametrize("clean, written, read", [(5, "cp1251", "cp1252"), (5, "koi8-r", "cp1251"), (3, "cp1252", "mac_roman"), (0, "utf-8", "latin-1")])
def test_a_source_damaged_as_a_whole(clean, written, read):
    texts = [t for t in CLEAN for _ in range(40)]
    bad = damaged(CLEAN[clean].replace("\u201c", "").replace("\u201d", ""), written, read)
    pairs, n = G.count_pairs(texts + [bad] * (len(texts) // 2))
    keys, back = np.unique(pairs, return_inverse=True)
    m = G.Mender(G.PairModel(keys, np.bincount(back, n).astype(np.int64)))
    assert m.text(bad)[0] == CLEAN[clean].replace("\u201c", "").replace("\u201d", "")
    assert [t for t in CLEAN if m.text(t)] == []


@pytest.mark.parametrize("sent", [100_000, 0])
def test_single_words_by_the_words_of_the_corpus(spark, monkeypatch, sent):
    monkeypatch.setattr(G, "SENT_WORDS", sent)
    texts = [t for t in CLEAN for _ in range(40)]
    bad = [("Přinesla ho, ale kdo", "Přinesla", "cp1250", "cp1252"), ("Der Fels dort ist rau, müsste täglich", "täglich", "cp1252", "cp850"), ("El agua, según dice", "según", "cp1252", "mac_roman"), ("(větší) most", "větší", "iso8859-2", "cp1252")]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10_000 + k, t.replace(w, damaged(w, a, b))) for k, (t, w, a, b) in enumerate(bad)]
    got = {r.doc_id: r.restored for r in G.garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10_000 + k: t for k, (t, *_) in enumerate(bad)}


def test_segments():
    assert G.segments([]) == [] and G.segments([-1, -2]) == []
    assert G.segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1), (2, 3), (4, 11)]
