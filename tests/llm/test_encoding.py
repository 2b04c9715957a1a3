from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import encoding as m

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def pieces(texts, mask):
    raw = [t.encode() for t in texts]
    whole = b"".join(raw)
    bounds = m.piece_bounds(np.frombuffer(whole, np.uint8), np.cumsum([len(x) for x in raw], dtype=np.int64), mask).tolist()
    return whole, [whole[a:b] for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1 '\n\t\u00a0é日\u200b.,<|>_\U0001f600", max_size=120), min_size=1, max_size=5), st.sampled_from([1, 7, 63]))
def test_joined_pieces_give_the_ids_of_the_whole(texts, mask):
    whole, cut = pieces(texts, mask)
    assert b"".join(cut) == whole
    encode = m.encoder(*m.default_vocabulary()).encode_ordinary
    assert [i for p in cut for i in encode(p.decode())] == [i for t in texts for i in encode(t)]


def test_corpus(spark, reference):
    shared = "The filing of Braorlex gives 26.4 million for 2019 and the plan was kept. " * 20
    texts = ["", None, " ", "\n\n  x", "<|endoftext|> <|endoftext|>", shared, "Before it. " + shared, "naïve café 日本語 " * 200, "a" * 30_000, "word " * 50_000, "it's we're\r\n\r\n", "\u200b\u00a0", shared, "x\U0001f600y"]
    rows = [(i, t, [1]) for i, t in enumerate(texts)] + [(3, texts[3], None), (None, "null id", None)]
    found = m.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>")).collect()
    want = reference([r[1] for r in rows])
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in found) == sorted((-1 if r[0] is None else r[0], ids) for r, ids in zip(rows, want))


def test_empty_and_parameters(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert m.encode_corpus(none).collect() == []
    with pytest.raises(ValueError):
        m.encode_corpus(none, mean_chunk=100)
    with pytest.raises(ValueError):
        m.encode_corpus(none, path="/somewhere")


def test_shared_pieces_are_encoded_once():
    seen = []
    cache = m.PieceCache(lambda text: seen.append(text) or [1, 2], 10_000)
    for _ in range(3):
        cache[b"same"]
    assert seen == ["same"]
    small = m.PieceCache(lambda text: [1], 600)
    for i in range(100):
        small[b"piece%d" % i]
    assert small.held <= 600 and len(small) <= 3


def small_vocabulary(tmp_path):
    """Single bytes and a few tokens, some across a space."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"e ", b"e t", b"th", b"the", b"e the", b"n ", b"in", b"in ", b"a b", b" b"]
    path = tmp_path / "small.tiktoken"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {n}" for n, t in enumerate(tokens)))
    return str(path), r"[^\n]+|\n"


def test_joins_that_do_not_agree_are_encoded_again(spark, tmp_path):
    path, pattern = small_vocabulary(tmp_path)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["the", "in", "a", "b", "tee", "then", "été", "bane"], 400)) for _ in range(20)] + ["the the\n" * 50, "", "e t" * 300]
    encode = m.encoder(path, pattern).encode_ordinary
    found = m.encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path=path, pattern=pattern, mean_chunk=64).collect()
    assert {r.doc_id: list(r.ids) for r in found} == {i: encode(t) for i, t in enumerate(texts)}


def test_all_joins_agree_with_the_default_pattern():
    texts = ["The filing of Braorlex gives 26.4 million for 2019, and the plan - naïve - was kept. " * 40, "word  word\tword\n x1 2y " * 99]
    raw = [t.encode() for t in texts]
    whole, ends = b"".join(raw), np.cumsum([len(x) for x in raw], dtype=np.int64)
    bounds = m.piece_bounds(np.frombuffer(whole, np.uint8), ends, 63)
    kept = m.agreed(whole, bounds, ends, m.PieceCache(m.encoder(*m.default_vocabulary()).encode_ordinary, 10**7), 24)
    assert len(bounds) > 40 and kept.tolist() == bounds.tolist()
