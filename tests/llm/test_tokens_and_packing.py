"""Token counts and packing against the library itself."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from anamnesis.llm.arrays import text_bytes
from anamnesis.llm.packing import IdEncoder, pack
from anamnesis.llm.tokens import TokenCounter, token_counts
import pyarrow as pa

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}
COUNTER, ENCODER = TokenCounter(WORDS), IdEncoder(BYTES)
ODD = ["it's don't I'LL  we've \n\n x\n  y \n", "a<|endoftext|>b <|ENDOFTEXT|>x", "<|startoftext|><|endoftext|>", "a  b    c",
       "é ́a", "x\x1cy \x1d  z", "123 4.5%%%###   ", "", None, "\x00\x01 a\x7fb", "日本語 テキスト　안녕", "\t\ta\x0bb\x0c c\r\n\r\nd",
       "  lead", "\n", " ", "a\xa0b \xa0 c \xa0", "ΑΣ ας Σ", "İstanbul ǅ ﬁ", "aaaa" * 300, "'" * 7, "👩‍👩‍👧 ok", "×÷ȴɐ ß"]
SCHEMA = "doc_id long, text string, rank string, rest string, salt int"


def ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


def check(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    assert COUNTER.count(data, offsets).tolist() == [len(ids(WORDS, t)) for t in texts]
    made, counts = ENCODER.encode(data, offsets)
    at = 0
    for text, count in zip(texts, counts.tolist()):
        assert made[at:at + count].tolist() == ids(BYTES, text), repr(text)
        at += count


def test_odd_texts():
    check(ODD)
    rng = random.Random(5)
    check(["".join(rng.choice("ab' \n\t.9éÉß×<|>") for _ in range(60)) for _ in range(500)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_texts(texts):
    check([t.encode("utf-8", "ignore").decode() for t in texts])


def test_token_counts(spark):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(ODD)] + [(None, "a b", "x", "y", 1)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in token_counts(df, WORDS, limit=20).collect()}
    for i, text in enumerate(ODD):
        n = len(ids(WORDS, text))
        assert got[i] == (len((text or "").encode()), n, n > 20)
    assert got[None] == (3, 2, False)
    assert token_counts(df.limit(0), WORDS).count() == 0


def test_packing_is_a_round_trip(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(("the", "tokens", "Élan", "x9")) for _ in range(rng.randrange(0, 400))) for _ in range(250)]
    texts += ["the same text"] * 200 + ODD + ["word " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    window = 256
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pack(df, BYTES, window=window).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in rows:
        want = np.array([*ids(BYTES, text), 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(want[at:at + r.length])
            at += r.length
        assert at == len(want)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        short += window - at
    assert short < window


def test_packing_of_nothing_and_repeats(spark):
    df = spark.createDataFrame([(1, "a", "x", "y", 1), (1, "a", "x", "y", 1), (None, None, "x", "y", 1)], SCHEMA)
    assert sorted((str(r.doc_id), r.length) for r in pack(df, BYTES).collect()) == [("1", 2), ("1", 2), ("None", 1)]
    assert pack(df.limit(0), BYTES).count() == 0
