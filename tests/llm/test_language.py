import random
import zlib

import pytest

from trustlake.llm import language
from trustlake.llm.queries import QUERIES

TEXTS = {"aa": "the cat sat on the mat and the dog ran", "bb": "der hund und die katze sind im haus"}


def phrases(sample, text, window):
    """Greedy parse into longest strings of the sample, anew in each window."""
    n = 0
    for at in range(0, len(text), window):
        part, i = text[at : at + window], 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[i : j + 1] in sample:
                j += 1
            n, i = n + 1, j
    return n


@pytest.mark.parametrize("window", [7, 256])
def test_parse_equals_brute_force(monkeypatch, window):
    monkeypatch.setattr(language, "WINDOW", window)
    model = language.Model(TEXTS)
    texts = ["the hat and the house", "die katze ran", "zzz the", "x", "THE  Cat!! sat," * 9]
    symbols, at = model.encode(texts)
    got = model.phrases(symbols, at)
    for k, lang in enumerate(model.langs):
        sample, _ = model.encode([TEXTS[lang]])
        for i in range(len(texts)):
            part = symbols[at[i] : at[i + 1]]
            assert got[k, i] == phrases(bytes(sample), bytes(part), window)


def test_classify():
    model = language.Model(TEXTS)
    langs, scores = model.classify(["the dog", "der hund", None, "", "12 34", "---", "日本"])
    assert langs[:6] == ["aa", "bb", "und", "und", "und", "und"] and langs[6] in TEXTS
    assert all(0 <= s <= 1 for s in scores) and scores[2] == 0
    assert language.Model({}).classify(["the"]) == (["und"], [0.0])
    assert language.Model({"aa": "abc"}).classify(["abc"]) == (["aa"], [1.0])


def test_held_out_accuracy(spark, rows):
    sf = "/root/testdata/sf0.01"
    truth = dict(rows("select doc_id, lang from documents", sf))
    got = QUERIES["op9_language_id"](spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edges(spark, edges, nothing):
    texts = language.sample(edges)
    assert set(texts) == {"en", "fr"}
    rows = language.identify(edges, texts).collect()
    assert len(rows) == edges.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 7)} == {"und"}
    kept = language.keep_identified(edges, texts)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 5, 8, 9, 9]
    assert language.sample(nothing) == {}
    unlearned = language.keep_identified(edges, {}).collect()
    assert sorted(r.doc_id or 0 for r in unlearned) == [0, 4, 5, 5, 8, 9, 9]
    assert language.identify(nothing, texts).collect() == []
    assert {r.lang_pred for r in language.identify(edges, {}).collect()} == {"und"}


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([("x" * 1000, "en")] * 500, "text string, lang string")
    assert len(language.sample(docs, pieces=3, piece=10)["en"]) == 32


def test_copies_do_not_displace_texts(spark):
    texts = [f"text {'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(40)]
    rows = [(t, "en") for i, t in enumerate(texts) for _ in range(1 if i % 8 else 200)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    for pieces in (10, 30, 40):
        assert len(set(language.sample(docs, pieces=pieces)["en"].split("\n"))) == pieces
    more = language.sample(docs, pieces=50)["en"].split("\n")
    assert len(more) == 50 and set(more[:40]) == set(texts)


def test_every_language_has_its_letters():
    rng = random.Random(5)
    signs = [chr(0x4E00 + i) for i in range(400)]
    # Words of two signs; the languages share most signs, but no word.
    words = {"xx": [signs[i] + signs[i + 1] for i in range(0, 300, 2)],
             "yy": [signs[i] + signs[i + 2] for i in range(100, 398, 2)]}
    latin = {f"l{i}": "".join(rng.choices([chr(0x61 + i), "e", " "], k=3000)) for i in range(20)}
    model = language.Model({**latin, **{k: "".join(rng.choices(w, k=2000)) for k, w in words.items()}})
    for lang, own in words.items():
        found = model.classify(["".join(rng.choices(own, k=40)) for _ in range(20)])[0]
        assert found == [lang] * 20


@pytest.mark.parametrize("size", [30, 61, 62, 63, 64, 300])
def test_large_alphabets_equal_brute_force(monkeypatch, size):
    monkeypatch.setattr(language, "WINDOW", 50)
    rng = random.Random(size)
    signs = [chr(0x4E00 + i) for i in range(size + 3)]
    texts = {
        "xx": "".join(rng.choices(signs[:size], k=900)) + "".join(signs[:size]),
        "yy": "".join(rng.choices(signs[3:9], k=500)),
    }
    model = language.Model(texts)
    asked = ["".join(rng.choices(signs[:9], k=130)), "".join(rng.choices(signs, k=70)), texts["xx"][40:160]]
    symbols, at = model.encode(asked)
    got = model.phrases(symbols, at)
    for k, lang in enumerate(model.langs):
        for i, text in enumerate(asked):
            assert got[k, i] == phrases(texts[lang], text, 50)
