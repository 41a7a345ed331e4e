import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from sellerlens.llm import pieces
from tests.llm import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    model = pieces.model_bytes(PATH)
    return pieces.PieceTable(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def test_encodes_and_decodes_as_the_library(both):
    t, sp = both
    r = random.Random(3)
    alphabet = [*"abcdefgh  ▁ \n\téüñ日本梦①\x00", "\U0001F600", "the", "ation", "<s>", "</s>", "<0x41>", "   ", " " * 17, "▁▁"]
    for _ in range(3000):
        x = "".join(r.choices(alphabet, k=r.randint(0, 40)))
        ids = sp.encode(x)
        assert t.encode(x) == ids
        assert t.decode(ids) == sp.decode(ids)


def test_decodes_any_ids(both):
    t, sp = both
    r = random.Random(4)
    for _ in range(3000):
        ids = [r.choice([r.randrange(1, 32_000), r.randrange(3, 259), t.ids["▁"]]) for _ in range(r.randint(0, 8))]
        assert t.decode(ids) == sp.decode(ids)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 50_000, "日" * 20_000, "hello" * 10_000, "x y" * 10_000])
def test_long_texts(both, text):
    t, sp = both
    assert t.encode(text) == sp.encode(text)


def test_query_digests(spark, both):
    _, sp = both
    docs = cases.documents(spark)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs, PATH).collect()}
    want = set()
    for d in docs.collect():
        ids = sp.encode(d.text or "")
        want.add((d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == want
    assert pieces.digests(cases.empty(spark), PATH).count() == 0


def test_round_trip(spark):
    docs = cases.documents(spark)
    back = {(r.doc_id, r.text) for r in pieces.decode(pieces.encode(docs, PATH), PATH).collect()}
    assert back == {(d.doc_id, d.text or "") for d in docs.collect()}
