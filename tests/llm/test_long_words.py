"""Long words that collide under every polynomial hash modulo a power of two."""

import random

import numpy as np
import pyarrow as pa

from lumicurve.llm.common import LANE_BYTES, text_bytes, word_hashes, words_of
from lumicurve.llm.ngram_join import jaccard_components
from lumicurve.llm.quality import statistics


def thue_morse(letters):
    word = letters[0]
    swap = str.maketrans(letters, letters[::-1])
    while len(word) < 2048:
        word += word.translate(swap)
    return word


X, Y = thue_morse("ab"), thue_morse("ba")


def test_no_link_between_different_words(spark):
    rows = [(1, X), (2, Y), (3, f"{X} p q r s t"), (4, f"{Y} p q r s t"), (5, X), (6, f"{X} {Y} {X} {Y} {X}"), (7, f"{Y} {X} {Y} {X} {Y}")]
    out = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=85).collect()}
    # 6 and 7 hold the two four-word runs that alternate both words: the same set.
    assert out == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, 7: 6}


def test_no_false_repetition():
    text = " ".join([X, *"bcdefgh", Y, *"bcdefgh"])
    assert statistics(pa.array([text, text.replace(Y, X)]), 8).base["n_repeat_words"].tolist() == [0, 16]


def test_hashes_tell_all_words_apart():
    """Words of every length up to some lanes, tails behind them, one byte changed, zero bytes."""
    r = random.Random(1)
    words = {X, Y, X + "a", X + "b", "\0", "\0" * 2, "\0" * 8, "\0" * 9, "a\0", "a"}
    for size in [*range(1, 40), LANE_BYTES - 1, LANE_BYTES, LANE_BYTES + 1, 5000]:
        word = "".join(r.choice("abc") for _ in range(size))
        words |= {word, word[:-1] + "d", "d" + word[1:], word[: size // 2] + "d" + word[size // 2 + 1 :]}
    words = sorted(words)
    raw, starts = text_bytes(pa.array([" ".join(words), " ".join(words[::-1])]))
    begin, end, first = words_of(raw, starts)
    h = word_hashes(raw, begin, end)
    assert len(np.unique(h)) == len(words) and (h[: first[1]] == h[first[1] :][::-1]).all()
