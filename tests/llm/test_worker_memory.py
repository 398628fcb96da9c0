"""What a Python worker keeps in the pipeline: little for each segment, within bounds, and nothing of another operator."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from quaestor.llm import common, minhash, pieces


def _texts(n: int, words: int = 400) -> list[str]:
    rnd = random.Random(5)
    return [" ".join("".join(rnd.choices("abcdefghij", k=8)) for _ in range(words)) for _ in range(n)]


def test_a_remembered_segment_takes_few_bytes():
    c = pieces.Codec(pieces.default_model())
    c.compatible = c._compatible  # which would be remembered too
    tracemalloc.start()
    for t in _texts(50):
        c.run(t)
    each = tracemalloc.get_traced_memory()[0] / len(c.memory)
    tracemalloc.stop()
    assert len(c.memory) > 19_000 and each < 180


def test_few_remembered_segments_change_no_result():
    texts = ["", None, "a  b", "\u2581 x\u2581", "\u4e16\u754c \U0001f600 z\n\ty", *_texts(6, 300)]
    many, few = pieces.Codec(pieces.default_model()), pieces.Codec(pieces.default_model(), remember=100)
    for t in [*texts, *texts]:
        ids, n, text = few.run(t)
        assert (ids, n, text) == many.run(t)
        assert n == len(few.encode(t)) and text == few.decode(few.encode(t))
    assert len(few.memory) + len(few.older) < 1300 < len(many.memory)


def test_the_codec_goes_when_another_operator_comes():
    common._remembered.clear()
    pieces.codec(pieces.default_model())
    common.only("pieces", pieces.codec.cache_clear)
    common._table(common._powers, common._P, 1 << 16)
    common.only("minhash", common.give_back)
    assert pieces.codec.cache_info().currsize == 0
    assert len(common._powers[0]) == len(common._inverse_powers[0]) == 1
    common._remembered.clear()


def test_points_drawn_at_a_time_change_no_signature(monkeypatch):
    rng = np.random.default_rng(3)
    bags = [(rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(1, 5, n)) for n in (1, 7, 300, 3000)]
    got = minhash.bag_minhash(bags)
    monkeypatch.setattr(minhash, "POINTS", 1 << 19)
    assert np.array_equal(got, minhash.bag_minhash(bags))
