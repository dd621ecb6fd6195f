"""BPE codec and token trees against the public tokenizer."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from starfold.llm.bpe import BytePairs, decode_documents, encode_documents
from starfold.llm.common import vocabulary
from starfold.llm.token_counts import LEAF_CHARS, LONG_LEAF, TokenTree, count_with_edits, redactions

PATH = vocabulary("byte_bpe_50k.json")
ALPHABET = [*"ab the\n\t \r12'sSéß日\u200b \x85\x1c\x1f!?😀", "<|endoftext|>", "<|endof", "text|>", "tion", "heit"]


@pytest.fixture(scope="module")
def pairs():
    return BytePairs(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(PATH)


def texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, most))) for _ in range(n)]


def test_same_ids_and_text_as_the_public_tokenizer(pairs, public):
    for t in [*texts(1500, 40, 1), "x" * 5000, "heit" * 2000, "!" * 999, " " * 700, "\n" * 300 + "a"]:
        ids = public.encode(t, add_special_tokens=False).ids
        packed = pairs.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert pairs.decode(packed) == public.decode(ids, skip_special_tokens=False)


def test_heap_and_rank_array_agree(pairs):
    for t in texts(300, 30, 2):
        assert pairs.short(t.encode()) == pairs.long(t.encode())


def test_documents(spark, public):
    rows = [(1, "Hello  world\n", "x"), (2, None, None), (3, "", "y"), (1, "Hello  world\n", "x"), (None, "a<|endoftext|>b", "z"), (5, "é" * 40_000, "ids")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_documents(docs, PATH).collect()
    want = sorted((-1 if d is None else d, public.encode(t or "", add_special_tokens=False).ids, t or "") for d, t, _ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got) == want
    back = decode_documents(encode_documents(docs, PATH, decode=False), PATH)
    assert sorted(r["text"] for r in back.collect()) == sorted(t for _, _, t in want)
    assert encode_documents(docs.where("false"), PATH).count() == 0


def test_tree_follows_random_edits(pairs):
    rng = random.Random(3)
    for t in texts(300, 1500, 4):
        tree = TokenTree(t, pairs)
        for _ in range(5):
            a = rng.randint(0, len(tree.text))
            b = min(len(tree.text), a + rng.choice([0, 1, 3, 50, 700]))
            tree.replace(a, b, "".join(rng.choices(ALPHABET, k=rng.choice([0, 1, 2, 40, 900]))))
            assert tree.count == len(pairs.encode(tree.text)) // 4
            chars, tokens = tree.state
            assert sum(chars) == len(tree.text) and sum(tokens) == tree.count
            tree = TokenTree(tree.text, pairs, (chars, tokens))  # go on from kept leaves


def test_small_edits_encode_little(pairs):
    tree = TokenTree("some words of prose, " * 5000, pairs)
    assert tree.replace(50_000, 50_004, "other") < 2000
    with pytest.raises(ValueError, match="outside"):
        tree.replace(5, 2, "")


def test_edited_counts(spark, pairs):
    rows = [(1, "write to a.b@mail.example.com or 10.1.2.3 now"), (2, None), (3, ""), (None, "no data"), (1, "write to a.b@mail.example.com or 10.1.2.3 now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = count_with_edits(docs, PATH).collect()
    assert len(got) == 5
    for r in got:
        assert r["edited_tokens"] == len(pairs.encode(r["edited"])) // 4 == sum(r["leaf_tokens"])
    assert {r["edited"] for r in got} == {"write to <email> or <address> now", "", "no data"}
    assert redactions("x 1.2.3.4.5 y") and hashlib.sha256(b"").hexdigest()
    assert count_with_edits(docs.where("false"), PATH).count() == 0


def test_large_insertions_leave_short_leaves(pairs):
    rng = random.Random(6)
    big = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(30_000))
    tree = TokenTree("hello world, " * 60, pairs)
    tree.replace(300, 305, big)
    assert tree.count == TokenTree(tree.text, pairs).count
    recoded = tree.replace(90_000, 90_001, "x")
    assert recoded < 8 * LEAF_CHARS and tree.count == TokenTree(tree.text, pairs).count
    for k in range(200):  # growth at one place
        tree.replace(50_000, 50_000, " added words here" * 20)
        assert max(tree.state[0]) <= 2 * LONG_LEAF
    assert tree.count == TokenTree(tree.text, pairs).count and sum(tree.state[0]) == len(tree.text)
    tree.replace(10, len(tree.text) - 10, "")
    assert tree.count == TokenTree(tree.text, pairs).count
