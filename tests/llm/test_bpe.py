import base64
import hashlib
import random

import numpy as np
import pytest

from hanlake.llm import bpe
from tests.llm.helpers import documents

P = pytest.importorskip("public_tokenizers")


def library(name):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed=0):
    rng = random.Random(seed)
    some = ["", " ", "  ", "   x", "a  b", "a   b ", "\n\n x", "a\n b", "a \nb", " \t\r\n ", "it's they'LL we'd  ", "x" * 900, "ab" * 500, "aaa aaaa aaaaa",
            "<|endoftext|> <|im_end|>", "日本語 テキスト", "🙂🙂 👨‍👩‍👧", "a  b c", "é" * 300, "0123456789 12 3", "don't!!! ??", "​‍ z"]
    alphabet = "abcdeéßñ,. '\n\t  019日🙂AB-_"
    some += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(200)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    return some + [" ".join(rng.choice(words) for _ in range(300)) for _ in range(30)]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_ids_are_the_librarys(name):
    v, lib = bpe.vocabulary(P.path(name)), library(name)
    enc = bpe.Encoder(v)
    enc.learn(texts())
    for t in texts():
        ids = np.frombuffer(enc.encode(t), "<u4")
        assert ids.tolist() == lib.encode_ordinary(t), t
        assert v.decode(ids) == t.encode()


def test_json_vocabulary_is_the_tokenizers_one():
    from tokenizers import Tokenizer

    from hanlake.llm.packing import _encoder

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc = _encoder(P.path("byte_bpe_50k.json"))
    enc.learn(texts(3))
    for text in texts(3):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_queries_and_columns(spark, monkeypatch):
    path, lib = P.path("byte_bpe_multi_50k.tiktoken"), library("byte_bpe_multi_50k.tiktoken")
    rows = [*enumerate(texts(1)), (None, "a b"), (9000, None), (9000, None)]
    out = bpe.bpe_digests(documents(spark, rows), path).collect()
    want = []
    for i, t in rows:
        ids = np.array(lib.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert bpe.bpe_digests(documents(spark, []), path).collect() == []
    back = bpe.decode(bpe.encode(documents(spark, rows), path, "ids"), path).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert back[0].source == "src0"
