"""All listed strings of a text in one pass, however long the list.

Lists up to a bounded size become an automaton that travels with the tasks. Longer ones are found by rolling hashes: the windows of a
text of each length that the list has are tested against a Bloom filter of the list, whose size is bounded too.
"""

from __future__ import annotations

import heapq
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of the longest list that travels with the tasks; its automaton, in every worker, is larger
AUTOMATON_BYTES = 8 << 20
BLOOM_BITS_PER_STRING = 12
MAX_BLOOM_BITS = 1 << 28
BLOOM_HASHES = 4
#: bytes of text that are hashed at a time
WINDOW_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
ODD = 0xD6E8FEB86659FD93

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def exactly(text: str) -> str:
    return text


def spaced(text: str) -> str:
    """What stays the same when spaces become underscores."""
    return text.replace("_", " ")


def lowered(text: str) -> str:
    """Letters that differ in case alone become one, sign by sign."""
    low = text.upper()
    low = low.lower() if len(low) == len(text) else low
    if len(low) != len(text):  # some letters have longer forms
        one = ((c, c.upper()) for c in text)
        low = "".join((u if len(u) == 1 else c).lower()[0] for c, u in one)
    return low.replace("ς", "σ")


def folded(text: str) -> str:
    """What stays the same when white space becomes an underscore or letters change their case."""
    return re.sub(r"[\s_]+", " ", lowered(text))


def spaced_column(name: str) -> Column:
    return F.translate(F.col(name), "_", " ")


def folded_column(name: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(folded, na_action="ignore")

    return F.pandas_udf(run, "string")(F.col(name))


def _finder(listed: Sequence[str], same: Callable[[str], str]) -> Callable[[str], list[int]]:
    """The places in the list of all strings that a text contains, both compared after `same`."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for place, string in enumerate(listed):
        places.setdefault(same(string), []).append(place)
    everywhere = places.pop("", [])
    automaton = ahocorasick.Automaton()
    for string, at in places.items():
        automaton.add_word(string, at)
    if places:
        automaton.make_automaton()

    def find(text: str) -> list[int]:
        at = set(everywhere)
        if places:
            for _, found in automaton.iter(same(text)):
                at.update(found)
        return sorted(at)

    return find


def _mapped(text: Column, make: Callable[[], Callable[[str], object]], kind: str) -> Column:
    """A function of single texts, which each task makes once; null stays null."""
    state: list = []

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not state:
            state.append(make())
        for texts in batches:
            yield pd.Series([None if t is None else state[0](t) for t in texts], dtype=object)

    return F.pandas_udf(run, kind)(text)


def hits(text: Column, listed: Sequence[str]) -> Column:
    """The listed strings that a text contains, in list order, each once."""

    def make():
        find = _finder(listed, exactly)
        return lambda t: [listed[k] for k in find(t)]

    return _mapped(text, make, "array<string>")


def rewritten(text: Column, listed: Sequence[str], by: Sequence[str], same: Callable[[str], str]) -> Column:
    """Each listed string replaced, in list order, by the one in `by`; only those that one pass finds are looked for.

    `same` must not change when a string is replaced, so that what is found at first is all that can be found later.
    """

    def make():
        find = _finder(listed, same)

        def rewrite(t: str) -> str:
            for k in find(t):
                t = t.replace(listed[k], by[k])
            return t

        return rewrite

    return _mapped(text, make, "string")


#: white space of regular expressions with Unicode classes
_GAP = re.compile("([\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+)")


def _word_sign(sign: str) -> bool:
    return sign == "_" or unicodedata.category(sign)[0] in "LN"


class Joiner:
    """Joins the parts of listed pairs in a text by underscores, in list order, in time that does not grow with the list.

    A pair is joined where a piece between white space ends with its left part, at a word boundary, and the next piece begins with its
    right part, whatever the case. A join makes one piece of two, which later pairs of the list may meet.
    """

    def __init__(self, pairs: Sequence[tuple[str, str]]):
        self.rights: dict[str, dict[str, list[int]]] = {}
        for place, (left, right) in enumerate(pairs):
            self.rights.setdefault(lowered(left), {}).setdefault(lowered(right), []).append(place)
        self.lefts = sorted({len(left) for left in self.rights})
        self.sizes = {left: sorted({len(r) for r in rights}) for left, rights in self.rights.items()}

    def _found(self, left: str, right: str, used: tuple[int, int]) -> Iterator[tuple[int, int]]:
        """(place in the list, length of the right part) of the pairs that fit between two pieces."""
        for n in self.lefts:
            if n > len(left):
                return
            rights = self.rights.get(left[-n:])
            if rights is None or (n < len(left) and _word_sign(left[-n - 1])):
                continue
            for size in self.sizes[left[-n:]]:
                if size > len(right):
                    break
                for place in rights.get(right[:size], ()):
                    # of one pair, what a match has taken is not taken again
                    if not (place == used[0] and len(left) - n < used[1]):
                        yield place, size

    def __call__(self, text: str) -> str:
        parts = _GAP.split(text)
        pieces, gaps = parts[::2], parts[1::2]
        if not gaps:
            return text
        low = [lowered(p) for p in pieces]
        before, after = list(range(-1, len(pieces) - 1)), list(range(1, len(pieces) + 1))
        used = [(-1, 0)] * len(pieces)
        heap = [(place, k, k + 1, size) for k in range(len(gaps)) for place, size in self._found(low[k], low[k + 1], (-1, 0))]
        heapq.heapify(heap)
        closed = [False] * len(gaps)
        # a piece is known by its first number; a gap by the piece that follows it at the start
        while heap:
            place, a, b, size = heapq.heappop(heap)
            if closed[b - 1] or after[a] != b or pieces[a] is None:
                continue
            if (place, size) not in set(self._found(low[a], low[b], used[a])):
                continue
            closed[b - 1] = True
            used[a] = (place, len(low[a]) + 1 + size)
            pieces[a], low[a] = f"{pieces[a]}_{pieces[b]}", f"{low[a]}_{low[b]}"
            pieces[b] = None
            after[a] = after[b]
            if after[a] < len(pieces):
                before[after[a]] = a
                for again, length in self._found(low[a], low[after[a]], used[a]):
                    if again >= place:
                        heapq.heappush(heap, (again, a, after[a], length))
            if before[a] >= 0:
                for again, length in self._found(low[before[a]], low[a], used[before[a]]):
                    if again > place:
                        heapq.heappush(heap, (again, before[a], a, length))
        out = [pieces[0]]
        for k, gap in enumerate(gaps):
            if pieces[k + 1] is not None:
                out += [gap, pieces[k + 1]]
        return "".join(out)


def joined(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return _mapped(text, lambda: Joiner(pairs), "string")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(ODD)
    return x ^ (x >> np.uint64(29))


class _Rolling:
    """Hashes of all windows of some bytes, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.powers):
            size = 1 << int(n).bit_length()
            out = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                out.append(np.cumprod(steps, dtype=np.uint64))
            self.powers, self.inverses = out

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((sums[start + length] - sums[start]) * self.inverses[start])


def _bit(code: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The `k`-th bit of a hash in the filter."""
    return (code + np.uint64(k) * ((code >> np.uint64(17)) | np.uint64(1))) & np.uint64(bits - 1)


def _bloom(strings: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the binary column `string`, as words of 64 bits; the tasks give the words they set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling()
        for batch in batches:
            parts = batch.column(0).to_pylist()
            data = np.frombuffer(b"".join(parts), dtype=np.uint8)
            sizes = np.array([len(p) for p in parts], dtype=np.int64)
            code = rolling.windows(rolling.sums(data), np.cumsum(sizes) - sizes, sizes)
            at = np.concatenate([_bit(code, k, bits) for k in range(BLOOM_HASHES)])
            word, place = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(value, place, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

    words = strings.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(max(1, bits >> 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("value").to_numpy().view(np.uint64)
    return out


def windows_found(texts: DataFrame, keys: Sequence[str], strings: DataFrame, text: str = "text", column: str = "ngram") -> DataFrame:
    """(keys, string): for each row of `texts` the strings of any table that its text contains, once per row.

    The filter leaves little besides true hits, which alone are shuffled; a string that many rows contain is joined in
    parts. The work on a text grows with the number of different lengths, not with the number of strings.
    """
    wanted = strings.select(F.col(column).cast("binary").alias("_string")).distinct()
    sizes = wanted.groupBy(F.octet_length("_string").alias("length")).agg(F.count("*").alias("strings")).collect()
    # as many values as there are different lengths
    lengths = sorted(r.length for r in sizes if r.length)
    total = sum(r.strings for r in sizes)
    bits = min(MAX_BLOOM_BITS, 1 << max(10, (BLOOM_BITS_PER_STRING * total).bit_length()))
    everywhere = any(r.length == 0 for r in sizes)
    shared = texts.sparkSession.sparkContext.broadcast(_bloom(wanted.where(F.octet_length("_string") > 0), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, bloom = _Rolling(), shared.value

        def emit(batch, rows, found):
            at = pa.array(np.array(rows, dtype=np.int64))
            return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array(found, pa.binary())], [*keys, "_string"])

        def chunks(parts: list):
            held, size = [], 0
            for row, part in enumerate(parts):
                if part is None:
                    continue
                held.append((row, part))
                size += len(part)
                if size >= WINDOW_BYTES:
                    yield held
                    held, size = [], 0
            if held:
                yield held

        for batch in batches:
            for held in chunks(batch.column(len(keys)).to_pylist()):
                whole = b"".join(p for _, p in held)
                data = np.frombuffer(whole, dtype=np.uint8)
                sizes = np.array([len(p) for _, p in held], dtype=np.int64)
                ends = np.repeat(np.cumsum(sizes), sizes)
                owner = np.repeat(np.arange(len(held)), sizes)
                begins = np.flatnonzero((data & 0xC0) != 0x80)  # where a character begins
                sums = rolling.sums(data)
                found: set = {(row, b"") for row, _ in held} if everywhere else set()
                for length in lengths:
                    start = begins[begins + length <= ends[begins]]
                    code = rolling.windows(sums, start, length)
                    for k in range(BLOOM_HASHES):
                        bit = _bit(code, k, bits)
                        hit = (bloom[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                        start, code = start[hit], code[hit]
                    for s, o in zip(start.tolist(), owner[start].tolist(), strict=True):
                        found.add((held[o][0], whole[s : s + length]))
                if found:
                    rows, strings_ = zip(*sorted(found))
                    yield emit(batch, rows, strings_)

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    met = texts.select(*keys, F.col(text).cast("binary")).mapInArrow(run, f"{schema}, _string binary")
    parts = 8
    met = met.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    spread = wanted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return met.join(spread, ["_string", "_part"]).select(*keys, F.col("_string").cast("string").alias(column))
