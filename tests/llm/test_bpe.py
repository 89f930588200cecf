import os
import random

import numpy as np
import pytest

from logfold.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no tokenizer file")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def mine(texts, **kw):
    ends, ids = bpe.Encoder(**kw).encode(texts)
    cut = [0, *ends.tolist()]
    return [ids[a:b].tolist() for a, b in zip(cut, cut[1:])]


EDGES = ["", "a", "aaaa", "aaaaa" * 201, " " * 500, "\n\n\n x", "<|endoftext|>", "it's we'll I'd", "\x1c\x1d a\x85\xa0b", "漢字。\n漢字", "é​﻿", "👩‍👩‍👧 ok", "x\r\n\r\n  y\t\n", "ab" * 3000, "1٣½ⅷ²", "a.\n\n\n    b", "end \n", " 　 z", "né\n\nà \n z"]


@pytest.mark.parametrize("text", EDGES)
def test_edges(public, text):
    assert mine([text]) == [public(text)]


def test_random_texts(public):
    rnd = random.Random(3)
    alphabet = "aab  \n\t'sd\x1c\x85\xa0é漢0१٣_.,!—😀Ǆ​﻿ⅷ½ªمrell<|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 90))) for _ in range(2000)]
    assert mine(texts) == [public(t) for t in texts]


def test_a_worker_that_forgets_its_words(public):
    texts = [f"word{i} other{i * 7} again" for i in range(300)]
    e = bpe.Encoder(kept=50)
    for i in range(0, 300, 40):
        ends, ids = e.encode(texts[i : i + 40])
        assert ids.tolist() == [x for t in texts[i : i + 40] for x in public(t)]


def test_frame(spark, public):
    long = "def f(x):\n    return x # é\n" * 40_000
    data = [(1, None), (2, ""), (3, "  "), (None, "x"), (4, "hello world"), (4, "hello world"), (5, long)]
    df = spark.createDataFrame([(*r, "clash") for r in data], "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in bpe.token_ids(df).collect()), key=lambda r: (r[0], len(r[1])))
    assert got == [(0, public("x")), (1, []), (2, []), (3, public("  ")), (4, public("hello world")), (4, public("hello world")), (5, public(long))]
    assert bpe.token_ids(df.limit(0)).count() == 0
    assert sorted((r[0] or 0, r[1]) for r in bpe.token_counts(df).collect()) == sorted((k, len(x)) for k, x in got)


def test_counts_of_words_without_letters():
    ids, count = bpe.replay(bpe.merges(bpe.TOKENIZER), [b"", b"a", b"", b" the"])
    assert count.tolist() == [0, 1, 0, 1] and len(ids) == 2
    assert bpe.replay(bpe.merges(bpe.TOKENIZER), [])[0].tolist() == []
    assert np.array_equal(bpe.Encoder().encode([])[1], [])
