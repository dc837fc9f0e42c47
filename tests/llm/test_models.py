"""Toxicity and language: held-out accuracy, and exact parts against brute force."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import language, toxicity
from tidemark.llm.common import read

FAMILIES = {"en": "the of and house water", "xx": "zog blip krum vaxo", "yy": "lamu tiki sola neko"}


def test_noisy_or():
    p = [0.2, 0.5, 0.01]
    expected = 1 - math.prod(1 - x for x in p)
    assert toxicity.noisy_or([math.log(x / (1 - x)) for x in p]) == pytest.approx(expected)
    assert toxicity.noisy_or([]) == 0.0 and 0 <= toxicity.noisy_or([800.0, -800.0]) <= 1


def test_toxic_sentences_are_learnt_and_located():
    texts, labels = [], []
    for i in range(300):
        y = i % 3 == 0
        texts.append(f"Nice day number {i}. {'You are a grumfle idiot.' if y else 'You are a friend.'} The end of it.")
        labels.append(int(y))
    model = toxicity.fit(texts, labels)
    text = "A quiet start. What a grumfle thing! More of the quiet."
    spans = [(a, b) for a, b, z in model.sentences(text) if z > 0]
    assert [text[a:b].strip() for a, b in spans] == ["What a grumfle thing"]
    assert toxicity.fit([], []).sentences("x") and toxicity.fit(["a"], [0]).weights == {}


def plain_score(model, text):
    """Noisy-or by its definition: 1 - product over sentences of 1 - logistic(bias + weights of the distinct words)."""
    hidden = 0.0
    for sentence in toxicity.SENTENCE.findall(text):
        words = set(toxicity.WORD.findall(sentence))
        if words:
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w))
            hidden += -math.log(1 / (1 + math.exp(z)))
    return 1 - math.exp(-hidden)


def test_toxicity_query_on_held_out_rows(spark):
    """Of the held-out fold alone: most toxic documents are found, hardly any clean one; scores are those of the plain formula."""
    sf_dir = "/root/testdata/sf0.1"  # the smaller tables have a handful of toxic held-out documents
    docs, table = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    labels = {r["doc_id"]: r["toxic"] for r in table.collect()}
    rows = toxicity.op9_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    clean = [r for r in held if labels.get(r["doc_id"]) == 0]
    toxic = [r for r in held if labels.get(r["doc_id"]) == 1]
    hits, wrong = sum(r["predicted"] for r in toxic), sum(r["predicted"] for r in clean)
    print(f"held out: {len(toxic)} toxic, {hits} found; {len(clean)} clean, {wrong} accused")
    assert hits >= 0.8 * len(toxic) and hits >= 0.9 * (hits + wrong)
    model = toxicity.train(docs, table)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    # the bound on features selects them (without it, some 2 % of predictions change); twice as many find and accuse about as many
    wide = toxicity.train(docs, table, max_features=2 * toxicity.MAX_FEATURES)
    found, accused = (sum(plain_score(wide, texts[r["doc_id"]]) >= 0.5 for r in kind) for kind in (toxic, clean))
    print(f"with twice the features: {found} found, {accused} accused")
    assert abs(found - hits) <= 0.03 * len(toxic) and abs(accused - wrong) <= 0.005 * len(clean)
    assert len(model.weights) <= toxicity.MAX_FEATURES < len(wide.weights) <= 2 * toxicity.MAX_FEATURES
    for r in rows[::7]:
        assert r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]]), abs=1e-9)


def test_toxicity_sample(spark):
    """Both classes are learnt even where all their documents are long; long clean documents stay clean."""
    fill = "A quiet line of prose about gardens. "
    rows = [(i, fill * (400 if i % 2 else 3) + ("You grumfle idiot. " if i % 4 == 1 else "")) for i in range(200)]
    rows += [(300, None), (4, "another text of the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(200)] + [(300, 1), (2, None), (999, 1)], "doc_id long, toxic int")
    texts, known = toxicity.sample(docs, labels)
    assert sum(known) == min(toxicity.MAX_LONG, sum(i % 4 == 1 and zlib.crc32(str(i).encode()) % 5 > 0 for i in range(200)))
    assert (texts, known) == toxicity.sample(docs.repartition(7), labels)
    model = toxicity.fit(texts, known)
    assert plain_score(model, fill * 5_000) < 0.5 < plain_score(model, fill * 5 + "You grumfle idiot.")


def test_thinned_texts(spark):
    text = "".join(f"sentence {i}. " for i in range(5_000))
    found = spark.createDataFrame([(text,), ("short.",), ("",), (None,)], "t string").select(toxicity.thinned(F.col("t"), 10_000, toxicity.PART)).collect()
    assert [r[0] for r in found[1:]] == ["short.", "", None] and 7_000 < len(found[0][0]) < 13_000
    parts = [p.strip() for p in found[0][0].split(".")[:-1]]
    assert int(parts[0].split()[1]) < 100 and int(parts[-1].split()[1]) > 4_900 and parts == sorted(parts, key=lambda p: int(p.split()[1]))


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (6, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["score"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    kept = toxicity.clean(odd, labels)
    assert kept.columns == odd.columns and toxicity.clean(empty, labels).isEmpty()


VOCABULARY = set(language.vocabulary())


def brute(model, word, k):
    """The sum over all segmentations into pieces of the whole vocabulary and single characters, by recursion."""
    word = language.SPACE + word
    known = dict(zip(model.pieces, model.probabilities[:, k]))

    def total(i):
        if i == len(word):
            return 1.0
        ends = [j for j in range(i + 1, len(word) + 1) if j == i + 1 or word[i:j] in VOCABULARY]
        return sum(known.get(word[i:j], model.floors[k]) * total(j) for j in ends)

    return math.log(total(0))


@pytest.fixture(scope="module")
def languages():
    return language.fit({k: [" ".join([v] * 5)] * 20 for k, v in FAMILIES.items()})


def test_every_piece_of_the_vocabulary_takes_part(languages):
    assert set(languages.pieces) == VOCABULARY and (languages.probabilities > 0).all()


@pytest.mark.parametrize("word", ["the", "water", "krumblip", "q", "ñ漢x", "thethewater", "international", "a", "漢"])
def test_words_sum_all_segmentations(languages, word):
    together = languages.forward([word, "other", word + "s"])
    for k in range(len(languages.languages)):
        assert languages._word(word)[k] == pytest.approx(brute(languages, word, k))
        assert together[0, k] == pytest.approx(brute(languages, word, k))
        assert together[2, k] == pytest.approx(brute(languages, word + "s", k))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="thewaronéñ漢", min_size=1, max_size=9), min_size=1, max_size=8, unique=True))
def test_words_together_and_one_by_one(languages, words):
    found = languages.forward(words)
    assert np.allclose(found, [languages._word(w) for w in words])


def test_predictions_are_those_of_brute_force(languages):
    texts = ["the water of zog", "lamu water, tiki 12 tiki!", "zog blip the krum", None, "", "12 ..", "漢 q", "The WATER"]
    for text, (name, score) in zip(texts, languages.predict(texts)):
        words = language.WORD.findall((text or "").lower())
        if not words:
            assert (name, score) == ("und", 0.0)
            continue
        totals = [sum(brute(languages, w, k) for w in words) for k in range(3)]
        best = max(range(3), key=lambda k: totals[k])
        assert name == languages.languages[best] and score == pytest.approx(1 / sum(math.exp(t - totals[best]) for t in totals))


def test_long_words_and_texts(languages, monkeypatch):
    short, long = languages._word("krum" * 8), languages._word("krum" * 800)
    assert all(math.isfinite(x) for x in long) and long[1] / 100 == pytest.approx(short[1], rel=0.1)
    texts = ["zog blip " * 400 + "krum" * 500, "lamu tiki the " * 300, "of"]
    whole = languages.predict(texts)
    monkeypatch.setattr(language.Model, "STEP", 7)  # texts of over 70 characters go in steps
    monkeypatch.setattr(language.Model, "KEPT", 3)
    languages.forget()
    assert [n for n, _ in languages.predict(texts)] == [n for n, _ in whole] == ["xx", "yy", "en"]


def test_language_sample(spark, monkeypatch):
    """Languages whose documents are all long are learnt; a dirty column brings its most frequent values alone."""
    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    monkeypatch.setattr(language, "MAX_DOCS", 20)
    rows = [(i, "zog blip krum " * (1_000 if i % 2 else 5), "xx" if i % 2 else "yy") for i in range(120)]
    rows += [(1000 + i, "noise", f"dirt {i}") for i in range(50)] + [(2000, None, "xx"), (2001, "a", None)]
    found = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(found) <= 3 and len(found["xx"]) == len(found["yy"]) == 20
    assert all(5_000 < len(t) < 11_000 for t in found["xx"]) and all(t == "zog blip krum " * 5 for t in found["yy"])


def test_language_edges(languages, odd, empty):
    assert languages.predict([None, "12 ... ²", ""]) == [("und", 0.0)] * 3
    assert languages.predict(["zog vaxo blip"])[0][0] == "xx"
    rows = language.identify(odd, languages).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    nobody = language.fit(language.sample(empty))
    assert {r["lang_pred"] for r in language.identify(odd, nobody).collect()} == {"und"}


def test_language_query_on_held_out_rows(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in read(spark, sf_dir, "documents").collect()}
    held = [r for r in language.op10_language(spark, sf_dir).collect() if r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
