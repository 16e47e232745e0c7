"""op2 and op8 against the tokenizer library itself."""

import random

import pytest
from pyspark.sql import functions as F

from sheetwise.llm import bpe_automaton, token_counts
from sheetwise.llm.bpe_tables import bpe_tables, library_tokenizer, split_words
from sheetwise.llm.registry import tokenizer_path

ODD = ["", " ", "a  b   c\n\n d", "x<|endoftext|>y  <|endoftext|>!!<|endoftext|>", "  <|endoftext|> <|endoftext|>",
       "a" * 90, " " * 40 + "x", "é中文 \U0001f600\U0001f600 ok", "'ll 'l ''s don't we're", "\r\n\t\x0b 12345 678٠",
       "a\n\nb\t\tc \n d\xa0\xa0e", "x\x1cy\x1fz ²³¼½", "<|end", "q" * 5000]


def texts(seed=3, n=400):
    rnd = random.Random(seed)
    out = list(ODD)
    for _ in range(n):
        out.append("".join(rnd.choice("aabehinrst \n'.,é0TH\t") for _ in range(rnd.randint(1, 50))))
        out.append("".join(chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x300, 0xD7FF),
                                           rnd.randint(0x10000, 0x1FFFF)])) for _ in range(rnd.randint(1, 20))))
        out.append("".join(rnd.choice(["<|endoftext|>", "<|end", " ", "!", "a's", "\n", "'r", "<"])
                           for _ in range(rnd.randint(1, 9))))
    return out


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


def test_encode_and_decode_as_the_library(path):
    lib, enc, dec = library_tokenizer(path), bpe_automaton.encoder(path), bpe_automaton.decoder(path)
    for t in texts():
        want = lib.encode(t, add_special_tokens=False).ids
        ids = enc.encode(t)
        assert ids.tolist() == want, t
        assert dec.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_count_at_every_prefix(path):
    lib, counter = library_tokenizer(path), token_counts.counter(path)
    for t in texts(5, 120):
        if len(t) <= 200:
            want = [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
            assert counter.prefixes(t) == want, t
        assert counter.total(t) == len(lib.encode(t, add_special_tokens=False).ids)


def test_fitting_prefix(path):
    counter = token_counts.counter(path)
    text = "the thanonou of  blethat\n\n 12 don't " * 5
    counts = counter.prefixes(text)
    for budget in (0, 1, 7, 40, 10_000):
        n = counter.fitting(text, budget)
        assert max(counts[:n + 1]) <= budget
        assert n == len(text) or counts[n + 1] > budget


def test_memo_tables_do_not_change_results(path, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "MAX_WORDS", 3)
    monkeypatch.setattr(bpe_automaton, "MAX_ARCS", 5)
    monkeypatch.setattr(token_counts, "MAX_WORDS", 3)
    monkeypatch.setattr(token_counts, "MAX_PAIRS", 5)
    lib = library_tokenizer(path)
    enc, counter = bpe_automaton.Encoder(path), token_counts.PrefixCounter(path)
    for t in texts(9, 60):
        want = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t).tolist() == want and counter.total(t) == len(want)


def test_automaton_arcs_are_the_pairs_that_stay_apart(path):
    tables = bpe_tables(path)
    automaton, rnd = bpe_automaton.TokenAutomaton(tables), random.Random(1)
    ids = sorted(tables.ids.values())
    for _ in range(20_000):
        a, b = rnd.choice(ids[:3000]), rnd.choice(ids[:3000])
        assert automaton.arc(a, b) == tables.stay_apart(a, b)


def test_words_split_as_the_library(path):
    for t in texts(11, 200):
        assert "".join(split_words(t)) == t


def test_frames_with_nulls_ties_and_clashing_columns(spark, path):
    rows = [(1, None, 7), (2, "", 8), (3, "the thing", 9), (3, "the thing", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumn("n_tokens", F.lit("x"))
    coded = bpe_automaton.decode(bpe_automaton.encode(df, path), path)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    got = sorted((r.doc_id, len(r.ids), r.decoded) for r in coded.collect())
    assert got == [(1, 0, ""), (2, 0, ""), (3, 2, "the thing"), (3, 2, "the thing")]
    both = bpe_automaton.encode_and_decode(df, path)
    assert both.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert sorted((r.doc_id, len(r.ids), r.decoded) for r in both.collect()) == got
    counted = token_counts.count_tokens(df, path)
    assert sorted((r.doc_id, r.n_tokens) for r in counted.collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert token_counts.truncate(df, path, 1).where("doc_id = 3").first().truncated == "the"
    assert token_counts.prefix_counts(df, path).where("doc_id = 2").first().prefix_tokens == [0]
    empty = df.limit(0)
    assert token_counts.count_tokens(empty, path).count() == 0
    assert bpe_automaton.encode(empty, path, drop_text=True).columns == ["doc_id", "n_tokens", "ids"]


def test_queries_as_the_library(spark, path):
    import __spark_entry__ as entry
    lib, d = library_tokenizer(path), "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    import hashlib
    for r in entry.queries()["op8_bpe_encode_decode"](spark, d).collect():
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    counted = entry.queries()["op2_token_counts"](spark, d).collect()
    assert len(counted) == len(docs)
    for r in counted:
        n = len(lib.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 512, len(docs[r.doc_id].encode()))
