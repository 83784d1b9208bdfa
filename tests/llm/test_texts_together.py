"""Operator 8 looks at many texts in one pass of numpy."""

import numpy as np
import pytest
from gridfuse.llm import suffix

TEXTS = [b"ab cd " * 40, b"", b"short", b"a " * 150, bytes(range(97, 122)) * 9, b"x" * 20, b"one two three four five six seven eight nine ten " * 5]


@pytest.mark.parametrize(("length", "gram", "words"), [(20, 8, False), (12, 5, True)])
def test_phrases_of_texts_together_equal_those_of_each_alone(length, gram, words):
    first, stop, kept, owner, offset, _, grams = suffix.phrases_of(TEXTS, length, gram, words)
    n = suffix.occurrences(kept, first, stop, grams, length, gram)
    assert len(n) == len(first) and (n > 0).all()
    for i, text in enumerate(TEXTS):
        mine, alone = owner == i, suffix.phrases_of([text], length, gram, words)
        if alone is None:
            assert not mine.any()
        else:
            for ours, theirs in zip((first[mine] - offset[i], stop[mine] - offset[i], kept[mine]), alone[:3], strict=True):
                np.testing.assert_array_equal(ours, theirs)
