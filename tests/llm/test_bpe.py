"""Tree concatenation against the plain tokenizer, on texts made to break window edges."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from depthlake.llm import bpe  # noqa: E402
from depthlake.llm.textbytes import slices  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "aaaa", "the", "ing", "'", "''", "'s", "'re", "'ll", "LL", "'VE", " ", "\n", " ", "é", "́", "̧́", "İ", "ß", "ﬁ", "漢字", "🙂",
        "👩‍👩‍👧", "1", "23", "!!", "--", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "한", "ᅡ", "각", "\x00", " ", "don't", "hello", "x" * 40, "-" * 30]


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(PATH)


def test_joined_parts_equal_the_whole(coder, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(bpe, "RIM", 4)
    for trial in range(800):
        some = rng.sample(BITS, rng.randint(1, 8))
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 160)))
        leaf = rng.choice([3, 5, 17, 40, 70])
        begins = bpe.halves(0, len(text), leaf)
        nodes = []
        for a, b in zip(begins, [*begins[1:], len(text)]):
            nodes.append(bpe.Node.rimmed(a, b, *coder.part(text[a:b])))
        want = coder.whole.encode(text, add_special_tokens=False).ids
        assert bpe.concatenate(coder, text, nodes).tolist() == want, (trial, leaf, text)


def test_pieces_equal_the_whole(coder):
    rng = random.Random(9)
    texts = ["".join(rng.choice(BITS + ["A", "Z.", "x,y", "(9)", "\x1c", "\x7f", ".́", "á", "é.", "—.", "I'D", "'Re"]) for _ in range(60)) for _ in range(400)]
    for part in slices(pa.array([t for t in texts if "<|endoftext|>" not in t and "<|startoftext|>" not in t] + [""]), 3000):
        some = bpe.encode_slice(coder, part)
        for i, ids in enumerate(some.to_pylist()):
            text = part.buf[part.offsets[i]:part.offsets[i + 1]].tobytes().decode()
            assert np.frombuffer(ids, "<u4").tolist() == coder.whole.encode(text, add_special_tokens=False).ids, text


def test_operator_equals_the_library(spark, coder):
    rng = random.Random(4)
    texts = [None, "", " \n", "one", "a" * 5000, "don't " * 3000, "漢字" * 4000, "x'" * 4000, "<|endoftext|>" * 700]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 4000))) for _ in range(30)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(5, texts[5], "s"), (None, texts[6], "t"), (None, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = bpe.decode(bpe.encode(docs, PATH, leaf=1000), PATH).collect()
    assert sum(r["doc_id"] == 5 for r in got) == 2
    want = []
    for i, t, _ in rows:
        ids = coder.whole.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i or 0, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), coder.whole.decode(ids, skip_special_tokens=False)))
    have = [(r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256(r["ids"]).hexdigest(), r["decoded"]) for r in got]
    assert sorted(have) == sorted(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).count() == 0
