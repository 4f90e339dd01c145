"""Numbers for the words that a map task meets, and packed columns of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Vocabulary(dict):
    """Word -> its number, from 0 in the order of first use."""

    def __missing__(self, word: bytes | str) -> int:
        self[word] = n = len(self)
        return n

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def strings(self, first: int = 0) -> pa.Array:
        """The words, UTF-8 bytes, as strings in the order of their numbers, from number ``first``."""
        return pa.array(list(self)[first:], pa.binary()).cast(pa.string())


def list_array(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)
