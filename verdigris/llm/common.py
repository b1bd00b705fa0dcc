"""What the text operators share: bounded batches, words and 64-bit mixing."""

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ARROW_BYTES, bounded_batches  # noqa: F401

#: What separates words, as a class for Java and DuckDB patterns; bytes.split() uses the same six bytes.
NON_WORD = r"[\x20\x09-\x0D]+"
#: MB of text that one task should see where an operator chooses the number of its partitions.
TASK_MB = 24
#: Partitions of one shuffle at most: the driver keeps a record of each. From about 400 GB on, tasks take more than TASK_MB,
#: which they stream through in sorted order.
MOST_PARTS = 1 << 14


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, by one native aggregate."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def parts_for(n_bytes: int, mb: float = TASK_MB, least: int = 1) -> int:
    """Partitions of about mb MB each, and MOST_PARTS at most."""
    return min(MOST_PARTS, max(least, -(-n_bytes // int(mb * (1 << 20)))))


def dealt_by_bucket(df: DataFrame, bits: int) -> DataFrame:
    """df dealt by its column bucket (1 << bits of them), the rows of each bucket together. A partition of several buckets streams through them."""
    return df.repartition(min(MOST_PARTS, 1 << bits), "bucket").sortWithinPartitions("bucket")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix64 finisher), wrapping."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """XXH64 by word, kept for the words that come again; emptied when it has grown to `most` entries."""

    def __init__(self, seed: int = 0, most: int = 100_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: An odd multiplier for rolling hashes modulo 2^64 (from the golden ratio).
ROLL = np.uint64(0x9E3779B97F4A7C15)


def rolling(h: np.ndarray, n: int, by: np.uint64 = ROLL) -> np.ndarray:
    """Polynomial hash of every n consecutive values, wrapping; empty when there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= by
        out += h[j : j + m]
    return out


def code_points(data: bytes) -> int:
    """Characters of UTF-8 text: the bytes that don't continue one."""
    if data.isascii():
        return len(data)
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
