"""A text gives each of its q-grams once, whatever its number of places, and only those that are asked for."""

import numpy as np
import pyarrow as pa

from colloquy.operators import patterns as K


def test_grams_once_and_only_wanted():
    texts = ["abababab", "", None, "𝄞é", "b"]
    every = K.gram_buckets(pa.array(texts), [1, 2, 3]).to_pylist()
    assert [len(found) for found in every] == [len({t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}) for t in (t or "" for t in texts)]
    wanted = np.zeros(K.BUCKETS, bool)
    wanted[K.gram_buckets(pa.array(["b"]), [1]).to_pylist()[0]] = True
    assert [len(found) for found in K.gram_buckets(pa.array(texts), [1, 2, 3], wanted).to_pylist()] == [1, 0, 0, 0, 1]
