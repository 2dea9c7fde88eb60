"""Language ID: the forward pass against an enumeration of all segmentations, expected counts, held-out accuracy."""

import math

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from ledgerlens.llm import catalog, langid

SF01 = "/root/testdata/sf0.01"


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


@pytest.fixture(scope="module")
def book():
    names = langid.vocabulary()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(langid.VOCABULARY))
    every = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    assert set(names) == {x for x in every if x.lstrip("▁").isalpha() and x.count("▁") <= 1} and max(map(len, names)) > 15
    return langid.pieces(), {p: i for i, p in enumerate(names)}


def test_pieces_are_found(book):
    found, names = book
    some = list(names)[::37]
    key = np.array([langid.Pieces._key(p) for p in some] + [langid.Pieces._key("qxzqx")], np.uint64)
    assert found.find(key).tolist() == [*(names[p] for p in some), -1]


def test_forward_and_expected_counts_match_enumeration(book):
    found, names = book
    logp = np.vstack([np.log(np.random.default_rng(0).dirichlet(np.ones(found.n), 2).T), np.full((1, 2), -np.inf)])
    words = ["the", "station", "über", "a", "qzé", "ŧŧ", "communications", "responsibilities"]
    got = langid.word_scores(words, logp, found)
    want, count = np.zeros((len(words), 2)), np.zeros(found.n)
    for i, w in enumerate(words):
        ways = list(segmentations("▁" + w, names))
        for k in range(2):
            p = [math.exp(sum(logp[names[x], k] if x in names else langid.UNKNOWN for x in way)) for way in ways]
            want[i, k] = math.log(sum(p))
            if k == 1:
                for q, way in zip(p, ways):
                    for x in way:
                        if x in names:
                            count[names[x]] += 2 * q / sum(p)
    assert np.allclose(got, want)
    est = langid.expected_counts(words, np.full(len(words), 2.0), np.ones(len(words), int), logp, found)
    assert np.allclose(est[:-1, 1], count) and not est[:, 0].any()


def test_held_out_accuracy(spark):
    rows = catalog.QUERIES["op6_language_id"](spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_edge_cases(docs):
    df = docs([(1, "the station and the house", "en"), (2, "das haus und der hund", "de"), (3, "12 !!", None), (4, None, "en"), (5, "", "de"),
               (6, "x" * 5000, None), (7, "the the", None), (7, "the the", None)])
    model = langid.train(df)
    assert model["langs"] == ["de", "en"]
    rows = langid.predict(df.select("doc_id", "text"), model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 8 and [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and got[1]["lang_pred"] == got[7]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows)
    empty = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df.select("doc_id", "text"), empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_rare_languages_are_learned_at_every_size(docs):
    """Few rows of one language, some without letters, among many of others."""
    words = {"en": "the station and the house", "fr": "la gare et la maison"}
    rows = [(i, words["en" if i % 3 else "fr"], "en" if i % 3 else "fr") for i in range(2000)]
    rows += [(5000 + i, "das haus und der hund", "de") for i in range(3)]
    rows += [(6000 + i, "12 !!" if i else "la casa y el perro", "es") for i in range(400)]
    for max_rows in (40, 400, 4000):
        model = langid.train(docs(rows), max_rows=max_rows, rounds=2)
        assert model["langs"] == ["de", "en", "es", "fr"]
    got = langid.predict(docs([(1, "das haus und der hund")]).select("doc_id", "text"), langid.train(docs(rows), max_rows=40)).collect()
    assert got[0]["lang_pred"] == "de"


def test_shares_keep_the_bound():
    assert langid.shares({"a": 5_000_000, "b": 500, "c": 3_000_000}, 8000) == {"a": 3750, "b": 500, "c": 3750}
    assert langid.shares({"a": 3, "b": 2}, 8000) == {"a": 3, "b": 2}
    assert langid.shares({"a": 9, "b": 9, "c": 9}, 2) == {"a": 1, "b": 1, "c": 1}


def test_long_words_are_segmented_over_every_border(book, monkeypatch):
    found, _ = book
    logp = np.vstack([np.log(np.random.default_rng(2).dirichlet(np.ones(found.n), 3).T), np.full((1, 3), -np.inf)])
    words = ["communications" * 40, "überdiestation" * 9, "a" * 700, "qz" * 50]
    size, spans = langid._spans(["▁" + w for w in words], found)
    whole = langid._forward(spans, logp)[np.arange(len(size)), size]
    for stretch in (17, 40, 64):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        assert np.allclose(langid.word_scores(words, logp, found), whole)


def test_clashing_columns_are_replaced(docs, spark):
    df = spark.createDataFrame([(1, "the station", "en", 7.0, "x"), (2, "das haus", "de", 7.0, "x")],
                               "doc_id long, text string, lang string, score double, Lang_Pred string")
    out = langid.predict(df, langid.train(df, rounds=1))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {r["doc_id"]: r["lang_pred"] for r in out.collect()} == {1: "en", 2: "de"}
