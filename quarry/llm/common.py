"""Shared helpers of the training-data operators: shared scratch folder, row slices, vectorised byte hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.runtime import scratch, settle, ship

#: Bytes of text that the vectorised operators hold in numpy arrays at once (one longer text makes a slice of its own).
SLICE_BYTES = 1 << 20

#: A fixed odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the package goes to the executors first."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *taken: Iterable[str]) -> str:
    """name, with underscores before it until none of the taken column names equals it (case is ignored)."""
    have = {c.lower() for names in taken for c in names}
    while name.lower() in have:
        name = f"_{name}"
    return name


def id_crc(column: str = "doc_id"):
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def slices(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(texts):
        yield start, len(texts)


def spans(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """slices() of a string or binary column by its bytes, without making Python values of it all at once."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; those for a slice are kept per worker."""
    if n > len(_powers[0]):
        tables = []
        for b in (BASE, BASE_INVERSE):
            p = np.full(max(n, 2 * SLICE_BYTES), b, np.uint64)
            p[0] = 1
            tables.append(np.cumprod(p, dtype=np.uint64))
        if n > 2 * SLICE_BYTES:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Bytes:
    """Several byte strings in one array, each followed by a space, with hashes of any substring in O(1).

    data: uint8 array; begin, end: the strings' ranges; word_begin, word_end, word_doc: the runs without ASCII white space.
    """

    def __init__(self, strings: list[bytes]) -> None:
        blob = b" ".join(strings) + b" "
        self.data = np.frombuffer(blob, np.uint8)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.end = np.cumsum(lengths + 1) - 1
        self.begin = self.end - lengths
        self.n = len(strings)
        powers, self._inverse = _power_tables(len(self.data) + 1)
        self._sums = np.zeros(len(self.data) + 1, np.uint64)
        # 1 is added to each byte, so that zero bytes count too
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self._sums[1:])

    def words(self) -> None:
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[1:] = ~_WHITE[self.data]
        step = np.diff(inside)
        self.word_begin = np.flatnonzero(step == 1)
        self.word_end = np.flatnonzero(step == -1)
        self.word_doc = np.searchsorted(self.end, self.word_begin, "right")

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of data[begin:end] for each pair."""
        return (self._sums[end] - self._sums[begin]) * self._inverse[begin]

    def grams(self, n: int) -> np.ndarray:
        """The hash of data[i:i+n] for each i up to len(data) - n."""
        if len(self.data) < n:
            return np.zeros(0, np.uint64)
        return (self._sums[n:] - self._sums[:-n]) * self._inverse[: len(self.data) - n + 1]


def release() -> None:
    """Gives memory that a task no longer uses back to the system: the worker process stays, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""
