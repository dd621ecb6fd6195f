"""Caches that outlive a task in a worker."""

import gc
import weakref
from types import SimpleNamespace

from starfold.llm import bpe, langid, shingles, workers
from starfold.llm.common import vocabulary


def test_an_operator_empties_the_caches_of_the_one_before():
    model = langid.started(["aa"], ["▁", "a"])
    scorer = langid.scorer(SimpleNamespace(value=model))
    scorer.predict(["a aa aaa"])
    gone = weakref.ref(scorer)
    del scorer
    shingles.hold_words()
    assert not langid._scorers and gone() is None

    shingles.shingle_set("one two three", 2)
    assert len(shingles._words) >= 3
    shingles.hold_words()  # its own stay
    assert len(shingles._words) >= 3
    path = vocabulary("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        shared = SimpleNamespace(value=(path, f.read()))
    pairs = bpe.byte_pairs(shared)
    assert not shingles._words and bpe.byte_pairs(shared) is pairs
    pairs.encode("one two")
    gone = weakref.ref(pairs)
    del pairs
    gc.disable()
    try:
        workers.hold("another")
        assert not bpe._loaded and gone() is None
    finally:
        gc.enable()
