"""Search for many byte patterns at once, and what is built on it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SLICE = 8 << 20
#: Pairs that are looked up at once: small enough for a processor's cache.
PIECE = 1 << 17


def _nonzero(x: np.ndarray) -> np.ndarray:
    """Places of the ones in an array of bytes 0 and 1, most of which are 0: eight at a time first."""
    n = len(x) // 8 * 8
    words = np.flatnonzero(x[:n].view(np.uint64))
    rows = x[:n].reshape(-1, 8)[words]
    at, byte = np.nonzero(rows)
    return np.concatenate([words[at] * 8 + byte, n + np.flatnonzero(x[n:])])


class Automaton:
    """All places of all patterns, overlapping ones and suffixes of others too; empty patterns are ignored.

    Vectorised: one look-up by each pair of neighbouring bytes, the even and the odd pairs each as an array of 16-bit numbers, tells
    where a pattern can begin, for all patterns at once; the few places left are compared byte by byte, pattern by pattern. The
    cost hardly depends on the number of patterns.
    """

    def __init__(self, patterns: Iterable[tuple[bytes, str]]) -> None:
        self.patterns = list(dict.fromkeys((p, n) for p, n in patterns if p))
        self._pairs = np.zeros(1 << 16, np.uint16)  # by the first byte and, above it, the second: little-endian
        self._groups: dict[int, list[int]] = {}
        self._single: list[int] = []
        known: dict[int, int] = {}
        for i, (p, _) in enumerate(self.patterns):
            if len(p) == 1:
                self._single.append(i)
                continue
            pair = p[0] | p[1] << 8
            group = known.setdefault(pair, len(known) + 1)
            self._pairs[pair] = group
            self._groups.setdefault(group, []).append(i)
        self._some = (self._pairs > 0).view(np.uint8)

    def _begins(self, data: np.ndarray) -> np.ndarray:
        """Places whose two bytes begin a pattern."""
        found = []
        for begin in (0, 1):
            pairs = np.ascontiguousarray(data[begin : begin + (len(data) - begin) // 2 * 2]).view("<u2")
            for a in range(0, len(pairs), PIECE):
                hit = np.take(self._some, pairs[a : a + PIECE], mode="clip")
                found.append(2 * (a + _nonzero(hit)) + begin)
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def places(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, place in data, number of the pattern) in uint8 data that holds strings up to ends one after another."""
        at_all, which = [], []
        for i in self._single:
            at = np.flatnonzero(data == self.patterns[i][0][0])
            at_all.append(at)
            which.append(np.full(len(at), i))
        if self._groups and len(data) > 1:
            at = self._begins(data)
            group = self._pairs[data[at] | data[at + 1].astype(np.uint16) << 8]
            order = np.argsort(group, kind="stable")
            at, group = at[order], group[order]
            cuts = np.searchsorted(group, np.arange(len(self._groups) + 2))
            for g, own in self._groups.items():
                for i in own:
                    p = self.patterns[i][0]
                    here = at[cuts[g] : cuts[g + 1]]
                    here = here[here <= len(data) - len(p)]
                    for j in range(2, len(p)):
                        here = here[data[here + j] == p[j]]
                    at_all.append(here)
                    which.append(np.full(len(here), i))
        if not at_all:
            none = np.zeros(0, np.int64)
            return none, none, none
        at, i = np.concatenate(at_all), np.concatenate(which)
        string = np.searchsorted(ends, at, "right")
        size = np.array([len(p) for p, _ in self.patterns])
        inside = at + size[i] <= ends[string]
        return string[inside], at[inside], i[inside]

    def search(self, data: bytes, base: int = 0) -> Iterator[tuple[int, bytes, str]]:
        """(offset, pattern, name) in data, by offset."""
        _, at, which = self.places(np.frombuffer(data, np.uint8), np.array([len(data)]))
        for k in np.lexsort((which, at)):
            yield base + int(at[k]), *self.patterns[which[k]]


def _searched(blocks: DataFrame, patterns: list[tuple[bytes, str]], keys: tuple[str, ...], own: str | None, fields: str, rows_of: Callable) -> DataFrame:
    """keys and fields of blocks(keys, offset, payload[, own]): rows_of(machine, row, place, which, offset) gives (row, columns) of the
    matches in a stretch of blocks, which are searched in the Arrow buffers that they come in, several at a time."""
    schema = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys) + ", " + fields
    names = [*keys, *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(patterns)
        for batch in batches:
            payload = batch.column("payload")
            payload = pa.array(payload.to_pylist(), pa.large_binary()) if payload.type not in (pa.binary(), pa.large_binary()) else payload.cast(pa.large_binary())
            offsets = np.frombuffer(payload.buffers()[1], np.int64, len(payload) + 1, payload.offset * 8)
            whole = np.frombuffer(payload.buffers()[2] or b"", np.uint8)
            base = batch.column("offset").fill_null(0).to_numpy(zero_copy_only=False)
            limit = batch.column("_own").fill_null(1 << 62).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(payload):
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE, "right")) - 1)
                data = whole[offsets[begin] : offsets[end]]
                string, at, which = machine.places(data, offsets[begin + 1 : end + 1] - offsets[begin])
                row = string + begin
                place = at - (offsets[row] - offsets[begin])
                keep = place < limit[row]
                row, columns = rows_of(machine, row[keep], place[keep], which[keep], base)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), *columns], names)
                begin = end

    limit = F.col(own).cast("long") if own else F.lit(None).cast("long")
    return blocks.select(*keys, F.col("offset").cast("long").alias("offset"), F.col("payload").cast("binary").alias("payload"), limit.alias("_own")).mapInArrow(run, schema)


def matches(blocks: DataFrame, patterns: list[tuple[bytes, str]], keys: tuple[str, ...] = ("image",), own: str | None = None) -> DataFrame:
    """keys, offset, extension, pattern of blocks(keys, offset, payload[, own]).

    own names a column with the number of bytes that belong to the block: a match that begins beyond them is the next
    block's. A null payload has no match.
    """

    def rows_of(machine: Automaton, row: np.ndarray, place: np.ndarray, which: np.ndarray, base: np.ndarray) -> tuple:
        texts, names = pa.array([p for p, _ in machine.patterns], pa.binary()), pa.array([n for _, n in machine.patterns], pa.string())
        kind = pa.array(which)
        return row, [pa.array(base[row] + place, pa.int64()), names.take(kind), texts.take(kind)]

    return _searched(blocks, patterns, keys, own, "offset long, extension string, pattern binary", rows_of)


def counts(blocks: DataFrame, patterns: list[tuple[bytes, str]], keys: tuple[str, ...] = ("image",), own: str | None = None) -> DataFrame:
    """keys, extension, n: how many matches matches() has. They are counted where they are found; no row per match is made."""

    def rows_of(machine: Automaton, row: np.ndarray, place: np.ndarray, which: np.ndarray, base: np.ndarray) -> tuple:
        names, many = pa.array([n for _, n in machine.patterns], pa.string()), len(machine.patterns)
        pairs, n = np.unique(row * many + which, return_counts=True)
        return pairs // max(1, many), [names.take(pa.array(pairs % max(1, many))), pa.array(n, pa.int64())]

    found = _searched(blocks, patterns, keys, own, "extension string, n long", rows_of)
    return found.groupBy(*keys, "extension").agg(F.sum("n").alias("n"))


def first_headers(found: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """One match for each offset: that of the shortest pattern, then by extension."""
    w = Window.partitionBy(*keys, "offset").orderBy(F.length("pattern"), "extension")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def occurrences(text: Column, pattern: str) -> Column:
    """Places, from 0, of all occurrences of a text pattern, overlapping ones too, without leaving generated code's side."""
    return F.filter(F.sequence(F.lit(0), F.length(text) - len(pattern)), lambda i: F.substring(text, i + 1, F.lit(len(pattern))) == F.lit(pattern))


def last_end(text: Column, marker: str) -> Column:
    """End of the last occurrence of marker, 0 if there is none: the size of a file that ends with it."""
    back = F.instr(F.reverse(text), marker[::-1])
    return F.when(back > 0, F.length(text) - back + 1).otherwise(0)


def any_of(text: Column, parts: Iterable[str]) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in parts])
