import hashlib
import random

import numpy as np
import pytest

from sourcelens.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairCoder(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(bpe.tokenizer_path())
    out.no_truncation()
    out.no_padding()
    return out


TEXTS = [
    "", " ", "Hello World's café 123 foo!!", "<|endoftext|>a<|startoftext|> b <|endoftext|", "ΣΑΣ İstanbul ﬁ é", "a\x1cb\x85c\xa0d",
    "aaaaaaaaaaaaaaaaaaa" * 40, "x\x00y", "日本語テキスト 👍🏽 ok", "'S'T'RE don't we'Ll", "½ ² 12345", "!!!!!!!!!!!!!!!???", "\x00", "\x00a", "\x00!!", "\uffffa \uffff",
]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(coder, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == want
    assert coder.decode(want) == library.decode(want, skip_special_tokens=False)
    n, ids, decoded = coder.digest(text)
    assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
    assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_random_words(coder, library):
    rng = random.Random(5)
    letters = "etaoinshrdluéèêñß'!?.-*#09"
    for _ in range(60):
        text = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 24))) for _ in range(200))
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_pair_check_is_exact(coder):
    """A pair is compatible exactly when merging its joined text gives the pair back."""
    rng = np.random.default_rng(3)
    ids = np.array([i for t, i in coder.proposable.items()])
    tokens = coder.tokens
    open_ids = np.array([i for i in ids if not tokens[i].endswith("</w>")])
    a, b = rng.choice(open_ids, 4000), rng.choice(ids, 4000)
    got = coder.compatible(a, b)
    for x, y, ok in zip(a, b, got):
        text = tokens[x] + tokens[y].removesuffix("</w>")
        if tokens[y].endswith("</w>"):
            assert ok == (coder.merge_exactly(text) == [x, y])


def test_long_text_in_blocks(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 7)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 6)
    text = "The quick brown foxes jumped over thirteen lazy dogs; naïve café. " * 30 + "z" * 500
    want = library.encode(text, add_special_tokens=False).ids
    own = bpe.BytePairCoder(bpe.tokenizer_path())
    assert own.encode(text) == want
    assert own.digest(text)[1] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_operator(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (0, "again", "y"), (0, "again", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_decode(docs, bpe.tokenizer_path(), with_ids=True).collect()
    assert len(out) == len(rows)
    want = sorted((i is not None, i or 0, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.token_ids) for r in out) == want
    assert bpe.encode_decode(docs.limit(0), bpe.tokenizer_path()).count() == 0
