"""op5: exact code lengths, held-out accuracy, defined results for odd input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.llm import language_id
from sheetwise.llm.language_id import ORDER, PpmModel, _grams, identify, train


def model_of(samples):
    langs = sorted(samples)
    grams = np.unique(np.concatenate([_grams(t.encode()) for ts in samples.values() for t in ts]))
    counts = np.zeros((len(grams), len(langs)))
    for i, lang in enumerate(langs):
        for t in samples[lang]:
            np.add.at(counts[:, i], np.searchsorted(grams, _grams(t.encode())), 1)
    return PpmModel(langs, grams, counts)


def slow_bits(texts, text):
    """Method-C code length by walking the contexts of one language byte by byte."""
    counts = {}
    for t in texts:
        data = b" " * ORDER + t.encode()
        for i in range(ORDER, len(data)):
            for order in range(ORDER + 1):
                node = counts.setdefault(data[i - order:i], {})
                node[data[i]] = node.get(data[i], 0) + 1

    def spread(context):
        if context is None:
            return [1 / 256] * 256
        lower = spread(context[1:] if context else None)
        node = counts.get(context)
        if not node:
            return lower
        total, distinct = sum(node.values()), len(node)
        left = sum(p for b, p in enumerate(lower) if b not in node)
        return [node[b] / (total + distinct) if b in node else distinct / (total + distinct) * p / left
                for b, p in enumerate(lower)]

    data = b" " * ORDER + text.encode()
    return -sum(np.log2(spread(data[i - ORDER:i])[data[i]]) for i in range(ORDER, len(data)))


def test_code_lengths_are_exact(monkeypatch):
    samples = {"en": ["the thing and then", "that one"], "fr": ["le chat élève", "la été"], "xx": ["aaaa"]}
    model = model_of(samples)
    for text in ("the chat", "élan vital", "zzz ☃ aa", " ", "a"):
        want = [slow_bits(samples[lang], text) for lang in model.langs]
        assert np.allclose(model.code_lengths(text), want, rtol=1e-5)
    whole = model.code_lengths("the chat and the élève " * 20)
    monkeypatch.setattr(language_id, "_CHUNK", 17)
    assert np.allclose(model.code_lengths("the chat and the élève " * 20), whole)


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = entry.queries()["op5_language_id"](spark, d).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.99


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "the thing and then that one is " * 5, "en", 1) for i in range(20)]
    rows += [(100 + i, "le chat élève été dans la maison " * 5, "fr", 1) for i in range(20)]
    rows += [(200, None, "en", 1), (201, "no label", None, 1), (None, "le chat", "fr", 1), (202, "the", "en", 1), (202, "the", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_odd_rows(spark, labelled):
    model = train(labelled, max_docs=1000)
    assert model.langs == ["en", "fr"]
    probe = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? _"), (4, "the thing " * 50_000), (5, "été")],
                                  "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(probe, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] == "en" and got[5][0] == "fr"
    assert identify(labelled, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert identify(labelled, model).count() == labelled.count()


def test_nothing_learnt(spark, labelled):
    model = train(labelled.limit(0))
    assert model.langs == []
    assert identify(labelled.where("doc_id = 1"), model).first().lang_pred == "und"
    assert identify(labelled.limit(0), model).count() == 0


def test_sample_is_bounded_and_by_id(labelled):
    small = train(labelled, max_docs=5)
    whole = train(labelled, max_docs=1000)
    assert 0 < small._counts.sum() < whole._counts.sum()
    assert np.array_equal(train(labelled, max_docs=5)._counts, small._counts)


def test_texts_in_no_language_or_in_two_go(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    apart = language_id.held_out(given["doc_id"])
    model = train(given.where(~apart))
    limits = language_id.fit_limits(given.where(apart), model)
    assert sorted(limits) == model.langs and all(a > 0 for a, _ in limits.values())
    rnd = random.Random(4)
    german, english = (given.where(f"lang = '{lang}' AND length(text) > 3000").orderBy("doc_id").first()["text"]
                       for lang in ("de", "en"))
    odd = {"noise": "".join(rnd.choice("asdfghjklqwertyuiop zxcvbnm") for _ in range(600)),
           "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.",
           "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
           "code": "for name, fn in queries().items():\n    if only and not any(o in name for o in only):\n        continue\n" * 3,
           "half": german[:1500] + english[:1500], "none": "12 34 !!", "empty": "", "null": None}
    good = {"german": german, "english": english, "short": english[:20], "letter": "a",
            "secret": english[:60] + ' token = "9dd3c80004c73dc9e548fee51b23b527780d4f20"',
            "long": english * 40}
    rows = spark.createDataFrame([(k, v, "x") for k, v in {**odd, **good}.items()] + [("german", german, None)],
                                 "name string, text string, `__fits` string")
    got = language_id.in_language(rows, model, limits)
    assert got.columns == rows.columns
    assert sorted(r.name for r in got.collect()) == sorted([*good, "german"])
    # hardly a given document goes: only some that are written in two languages or in capitals
    kept = language_id.in_language(given, model, limits).count()
    assert kept >= 0.999 * given.count()


def test_limits_without_rows(spark):
    docs = spark.createDataFrame([(i, "the cat and the hat " * 9, "en") for i in range(8)] + [(9, "le chat", "fr")],
                                 "doc_id long, text string, lang string")
    model = train(docs)
    assert language_id.fit_limits(docs.limit(0), model) == {"en": (np.inf, -np.inf), "fr": (np.inf, -np.inf)}
    some = language_id.fit_limits(docs.where("lang = 'en'"), model)
    assert some["fr"] == some["en"]  # none of its own: the widest of the others
    assert language_id.in_language(docs, model, some).count() == 9
    assert language_id.in_language(docs.limit(0), model, some).count() == 0
    none = train(docs.limit(0))
    assert language_id.fit_limits(docs, none) == {}
    assert language_id.in_language(docs, none, {}).count() == 0
    alone = train(docs.where("lang = 'en'"))  # one language has no second one
    assert language_id.in_language(docs.where("lang = 'en'"), alone,
                                   language_id.fit_limits(docs, alone)).count() == 8


def test_every_labelled_row_is_learnt_from_and_measured(spark, monkeypatch):
    docs = spark.range(3400).select("id", F.concat(F.lit("abcd "), F.lpad(F.hex("id"), 4, "0")).alias("text"),
                                    F.lit("en").alias("lang")).withColumnRenamed("id", "doc_id")
    model = train(docs)
    assert model._counts.sum() == 9 * 3400  # every byte of every text
    seen, quantiles = [], language_id.grouped_quantiles
    monkeypatch.setattr(language_id, "grouped_quantiles", lambda df, *a: seen.append(df.count()) or quantiles(df, *a))
    assert sorted(language_id.fit_limits(docs, model)) == ["en"]
    assert set(seen) == {3400}
