"""op12: ids against the library, first fit against a plain search, every id in one piece, no padding."""

import random
import zlib

import pytest
from tokenizers import Tokenizer

from sheetwise.llm import packing
from sheetwise.llm.packing import (CAPACITY, IdEncoder, encode_documents, fill_up, first_fit, pack, pack_group,
                                   packed, sequences)
from sheetwise.llm.registry import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library, monkeypatch):
    mine = IdEncoder(PATH)
    rnd = random.Random(3)
    alphabet = ["a", "B", "é", "É", "é", "Σ", "ς", "ß", "İ", "ı", "1", "²", "½", "٣", "_", "-", "'s", "'LL", " ", "\n", " ",
                " ", "…", "中", "文", "😀", "<|endoftext|>", "<|StartOfText|>", "<|", "ǅ", "ʰ", "̇", "ª", "Ⅷ", "ſ", "K", "\x85", "\x1c", "€", "\x00", "\x7f"]
    texts = ["", "Hello, World! It's 2024; don't", "x" * 5000, "ΟΔΟΣ ΣΑΣ", "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>"]
    texts += [f"a{chr(c)}b" for c in range(0x3001) if chr(c).isspace()]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    for text in texts:
        assert mine.encode(text) == packed(library.encode(text, add_special_tokens=False).ids), text
    monkeypatch.setattr(packing, "MAX_WORDS", 5)  # the tables are emptied over and over
    for text in ["a b c d e f g h", "a b", "h g f e d c b a i j k", "i", *texts[::20]]:
        assert mine.encode(text) == packed(library.encode(text, add_special_tokens=False).ids), text


def test_first_fit_is_the_plain_one():
    rnd = random.Random(5)
    for _ in range(300):
        cap = rnd.choice([4, 10, 64])
        lengths = sorted((rnd.randint(1, cap) for _ in range(rnd.randint(0, 60))), reverse=True)
        room, plain = [], []
        for n in lengths:
            b = next((i for i, r in enumerate(room) if r >= n), len(room))
            if b == len(room):
                room.append(cap)
            room[b] -= n
            plain.append(b)
        assert first_fit(lengths, cap) == plain


def test_groups_are_packed_whole_and_without_padding():
    rnd = random.Random(6)
    assert fill_up([]) == [] and pack_group([], []) == []
    for _ in range(300):
        cap = rnd.choice([1, 2, 8, 64])
        tokens = [rnd.randint(1, 3 * cap) for _ in range(rnd.randint(1, 50))]
        got = pack_group(list(range(len(tokens))), tokens, cap)
        totals = [sum(n for _, _, n in s) for s in got]
        assert all(t <= cap and t & (t - 1) == 0 for t in totals)
        assert sum(t < cap for t in totals) < max(2, cap.bit_length())
        spans = sorted((i, a, n) for s in got for i, a, n in s)
        for i, n in enumerate(tokens):  # the pieces of every item follow on one another
            at = 0
            for _, a, m in (p for p in spans if p[0] == i):
                assert a == at and m > 0
                at += m
            assert at == n


def test_frames(spark, library):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(["alpha", "Beta", "gamma!", "déjà"]) for _ in range(rnd.randint(0, 900))))
            for i in range(120)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (None, None), (7, "again"), (7, "again"), (1002, "long word " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS row_key", "3 AS `group`")
    encoded = encode_documents(df, PATH)
    pieces = pack(encoded, group_rows=40).collect()
    want = sorted(((d, packed(library.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows), key=str)
    keyed = {r.row_key: (r.doc_id, bytes(r.ids)) for r in encoded.collect()}
    assert sorted(keyed.values(), key=str) == want
    filled, seen = {}, {}
    for p in pieces:
        doc_id, ids = keyed[p.row_key]
        assert p.doc_id == doc_id and p.doc_tokens == len(ids) // 4
        assert p.ids_crc32 == zlib.crc32(ids[4 * p.start:4 * (p.start + p.length)])
        seen.setdefault(p.row_key, []).append((p.start, p.length))
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(seen) == set(keyed)
    for parts, total in [(v, len(keyed[k][1]) // 4) for k, v in seen.items()] + [(v, None) for v in filled.values()]:
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == total if total else (at <= CAPACITY and at & (at - 1) == 0)
    assert len({s >> 32 for s in filled}) == 4  # groups
    whole = {r.sequence_id: r for r in sequences(pack(encoded, group_rows=40), encoded).collect()}
    assert whole.keys() == filled.keys()
    for s in whole.values():
        assert bytes(s.ids) == b"".join(keyed[p.row_key][1][4 * p.start:4 * (p.start + p.length)] for p in s.pieces)
        assert s.n_tokens * 4 == len(s.ids)
    empty = encode_documents(df.limit(0), PATH)
    assert pack(empty).count() == 0 and sequences(pack(empty), empty).count() == 0
