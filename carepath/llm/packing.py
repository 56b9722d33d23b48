"""Best-fit packing by the configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits one sequence; the program asks for the
fewest uses of configurations that cover the histogram. It is solved by multiplicative weights:
in each round a knapsack dynamic program prices the lengths (best worth at every capacity), each
length's dearest configuration is used as far as demand lasts, and the prices of lengths left
uncovered rise while those that ran out fall; what the round left uncovered is covered from the
lengths with demand left. The mean of the rounds is rounded against the remaining demand, largest
remainders first; what is left, fewer pieces than lengths, is packed best-fit decreasing, on
counts. The histogram has at most as many rows as a
sequence has tokens, whatever the input, so this part runs on the driver; it gives a table of
configurations with counts. Pieces are then numbered within their length (in salted ranges, for
one length may hold most rows) and the number decides the sequence and the place in it.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carepath.llm.common import stored, valid
from carepath.llm.prefix_counts import byte_letters

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Tokens of a sequence, rounds of the program and how far one round moves a price.
SEQUENCE, ROUNDS, STEP = 2048, 24, 0.15
#: Parts between blanks that a task remembers in each of two generations, and the longest it keeps.
KEPT_PARTS, KEPT_CHARS = 300_000, 64
#: Texts of these characters only are cut at blanks and their parts looked up; others go to the library whole.
PLAIN = re.compile(r"[\x00-\x1B\x20-\u024F]*")


def _of_kind(kind: str) -> str:
    """The characters of PLAIN whose category begins so, for a pattern."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: Fixed value: the pieces that word_bpe_49k.json cuts lower-cased text into, for plain text, and line ends.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_of_kind('L')}]+|[{_of_kind('N')}]|[^\s{_of_kind('L')}{_of_kind('N')}]+|\n")


class Encoder:
    """The library's ids of whole texts, as bytes, remembering the parts between blanks.

    This vocabulary drops blanks and never joins across them, so a text's ids are those of its
    parts. New parts of a batch are cut into pieces and encoded together, as one line, by the same
    merges; each piece ends with the one token that closes a word, which tells the parts apart.
    Parts that are used live on: a full generation becomes the old one, and what is found there
    moves to the young one.
    """

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        # pieces come cut and with their bytes as letters
        self.cut = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.letters = "".join({0x0A: "\n", 0x20: " "}.get(b, c) for b, c in sorted(byte_letters().items()))
        vocabulary, end = self.cut.get_vocab(), spec["model"]["end_of_word_suffix"]
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(end)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.remember = KEPT_PARTS

    @cached_property
    def whole(self) -> Tokenizer:
        """For texts that are no plain ones; made when the first comes."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _learn(self, parts: list[str]) -> None:
        """Puts the ids of new parts without blanks into the young generation."""
        pieces = PIECES.findall("\n".join(parts).lower() + "\n")
        line = " ".join(pieces)
        if not line.isascii():
            line = line.encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.cut.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        piece_ends = np.r_[0, np.flatnonzero(self.closes[ids]) + 1]
        line_ends = np.flatnonzero(np.fromiter(map("\n".__eq__, pieces), bool, len(pieces)))
        ends = 4 * piece_ends[line_ends - np.arange(len(line_ends))]
        data, at = ids.tobytes(), 0
        for part, end in zip(parts, ends.tolist(), strict=True):
            self.young[part], at = data[at:end], end

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.split() if PLAIN.fullmatch(t) and not any(s in t for s in self.specials) else None for t in texts]
        if len(self.young) > self.remember:
            self.old, self.young = self.young, {}
        flat = [c for p in parts if p for c in p]
        found = list(map(self.young.get, flat))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = []
        for c in {flat[k] for k in missing}:
            if (ids := self.old.get(c)) is None:
                new.append(c)
            else:
                self.young[c] = ids
        if new:
            self._learn(new)
        for k in missing:
            found[k] = self.young[flat[k]]
        for c in new:
            if len(c) > KEPT_CHARS:
                del self.young[c]
        odd, at, out = [t for t, p in zip(texts, parts, strict=True) if p is None], 0, []
        whole = iter(self.whole.encode_batch_fast(odd, add_special_tokens=False) if odd else [])
        for p in parts:
            if p is None:
                out.append(array("I", next(whole).ids).tobytes())
            else:
                out.append(b"".join(found[at : at + len(p)]))
                at += len(p)
        return out


@lru_cache(maxsize=1)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", size: int = SEQUENCE, remember: int = KEPT_PARTS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (little-endian 32-bit) of every piece of every row.

    A Python worker remembers the ids of twice `remember` parts at most from one task to the next,
    about 0.2 kB each; fewer take more time and leave memory to what else runs there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        enc.remember = remember
        for b in batches:
            at, cut = [], []
            for row, ids in enumerate(enc.encode([t or "" for t in b.column(1).to_pylist()])):
                ids += b"\0\0\0\0"
                for k in range(0, len(ids), 4 * size):
                    at.append((row, k // (4 * size)))
                    cut.append(ids[k : k + 4 * size])
            piece = np.array([k for _, k in at], np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array([r for r, _ in at], pa.int32())),
                    pa.array(piece),
                    pa.array(piece.astype(np.int64) * size),
                    pa.array([len(c) // 4 for c in cut], pa.int64()),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                    pa.array(cut, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), valid(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, ids binary")


# ---- the program, on the histogram


def knapsack(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most worth at every capacity, and the length taken first there (-1: none fits better than at one less). Lengths rise."""
    worth, pick = np.zeros(size + 1), np.full(size + 1, -1)
    for c in range(1, size + 1):
        n = np.searchsorted(lengths, c, side="right")
        worth[c] = worth[c - 1]
        if n:
            value = worth[c - lengths[:n]] + prices[:n]
            k = int(value.argmax())
            if value[k] > worth[c] + 1e-12:
                worth[c], pick[c] = value[k], k
    return worth, pick


def _configuration(first: int, lengths: np.ndarray, pick: np.ndarray, size: int) -> Counter:
    found, c = Counter([first]), size - int(lengths[first])
    while c > 0:
        k = int(pick[c])
        if k < 0:
            c -= 1
        else:
            found[k] += 1
            c -= int(lengths[k])
    return found


def _remaining(first: int, lengths: list[int], pick: list[int], left: list[float], below: list[int], size: int) -> dict[int, int]:
    """A configuration of lengths with demand left only: the dearest ones, or the longest where those ran out."""

    def longest(k: int) -> int:
        top = k
        while top >= 0 and left[top] <= 0:
            top = below[top]
        while k > top:
            below[k], k = top, below[k]
        return top

    found, c = {first: 1}, size - lengths[first]
    while c >= lengths[0]:
        k = pick[c]
        if k < 0 or left[k] < found.get(k, 0) + 1:
            k = longest(bisect_right(lengths, c) - 1)
            while k >= 0 and k in found and left[k] < found[k] + 1:
                k = longest(below[k])
            if k < 0:
                break
        found[k] = found.get(k, 0) + 1
        c -= lengths[k]
    return found


def solve(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[dict[tuple, float], float]:
    """Fractional uses of configurations (tuples of (place of the length, copies)) that cover the demand, and a lower bound of the program."""
    prices, uses, bound = lengths / size, Counter(), float((lengths * demand).sum() / size)
    plain = [int(x) for x in lengths]
    for _ in range(ROUNDS):
        worth, pick = knapsack(lengths, prices, size)
        bound = max(bound, float((prices * demand).sum() / worth[size]))
        left = [float(d) for d in demand]

        def use(made: dict[int, int], left: list[float] = left) -> None:
            n = min(left[k] / a for k, a in made.items())
            if n > 0:
                uses[tuple(sorted(made.items()))] += n / ROUNDS
                for k, a in made.items():
                    left[k] -= n * a
                    if left[k] < 1e-9:
                        left[k] = 0.0

        for i in range(len(plain) - 1, -1, -1):
            if left[i] > 0:
                use(_configuration(i, lengths, pick, size))
        short = np.array(left) / demand
        picks, below = pick.tolist(), list(range(-1, len(plain) - 1))
        for i in range(len(plain) - 1, -1, -1):
            while left[i] > 0:
                use(_remaining(i, plain, picks, left, below, size))
        prices = prices * np.exp(STEP * (short - short.mean()))
    return uses, bound


def best_fit(counts: dict[int, int], size: int, begun: Iterable[tuple[tuple, int]] = ()) -> list[tuple[tuple, int]]:
    """Best-fit decreasing on counts, into the room of sequences begun before too: (lengths in order as (length, copies), uses)."""
    free: dict[int, list] = {}
    for made, k in begun:
        free.setdefault(size - sum(length * a for length, a in made), []).append([made, k])
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n > 0:
            room = min((f for f in free if f >= length), default=None)
            if room is None:
                room, group = size, [(), n]
            else:
                group = free[room].pop()
                if not free[room]:
                    del free[room]
            made, k = group
            each = min(room // length, n)
            used = min(k, n // each)
            if k > used and made:
                free.setdefault(room, []).append([made, k - used])
            free.setdefault(room - length * each, []).append([(*made, (length, each)), used])
            n -= used * each
    return [(made, k) for groups in free.values() for made, k in groups]


def rounded(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[Counter, np.ndarray, float]:
    """Whole uses of configurations (tuples of (length, copies), longest first), the demand they leave, and the lower bound.

    Fractional uses are rounded down, then up in the order of what that cut off, as far as demand
    lasts; the program is solved again for what is left, until fewer pieces are left than there are
    lengths. A pass uses configurations with little room left, each pass twice as much as the one before.
    """
    left, chosen, bound, room = demand.copy(), Counter(), 0.0, size // 256
    while left.any():
        at, before = np.flatnonzero(left), left.sum()
        uses, b = solve(lengths[at], left[at], size)
        bound = max(bound, b)  # what is left needs no more than the whole
        full = [made for made in sorted(uses) if size - sum(int(lengths[at[k]]) * a for k, a in made) <= room]
        rest = {made: uses[made] - int(uses[made]) for made in full}
        for up, order in ((0, full), (1, sorted(full, key=lambda made: (-rest[made], made[::-1])))):
            for made in order:
                n = min(1 if up else int(uses[made]), *(int(left[at[k]]) // a for k, a in made))
                if n > 0:
                    chosen[tuple((int(lengths[at[k]]), a) for k, a in reversed(made))] += n
                    for k, a in made:
                        left[at[k]] -= n * a
        if left.sum() < len(lengths) or (room >= size and left.sum() == before):
            break
        room = 2 * room + 1
    return chosen, left, bound


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> tuple[list[tuple[tuple, int]], float]:
    """Configurations with uses that cover the histogram exactly, and a lower bound of their number."""
    lengths = np.array(sorted(k for k in histogram if histogram[k] > 0), np.int64)
    if not len(lengths):
        return [], 0.0
    demand = np.array([histogram[int(k)] for k in lengths], np.int64)
    chosen, left, bound = rounded(lengths, demand, size)
    return best_fit({int(k): int(n) for k, n in zip(lengths, left, strict=True) if n}, size, sorted(chosen.items())), bound


def places(chosen: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """Ranges of piece numbers, sorted by length and number: from each, sequences and the offset are read."""
    rows, given, sequence = [], Counter(), 0
    for made, n in chosen:
        offset = 0
        for length, copies in made:
            for _ in range(copies):
                rows.append((length, given[length], sequence, offset))
                given[length] += n
                offset += length
        sequence += n
    rows.sort()
    length, first, seq, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
    return {"key": length << 44 | first, "first": first, "sequence": seq, "offset": offset}


def pack(cut: DataFrame, *, size: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, length, ids_crc32, ...).

    The table is read twice, so it should be stored. Rows that agree in all these columns may
    trade places. An empty table gives no row.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    where = places(plan(histogram, size)[0])
    salts = [(k, max(1, n // min(5000, max(200, n // 256)))) for k, n in histogram.items()]
    salts = F.broadcast(cut.sparkSession.createDataFrame(salts, "length long, salts long"))  # at most `size` rows
    salted = cut.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = salted.withColumn("number", number).join(before, ["length", "salt"]).withColumn("number", F.col("number") + F.col("before")).drop("before", "salt")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            k = np.searchsorted(where["key"], length.astype(np.int64) << 44 | number, side="right") - 1
            kept = [c for c in b.schema.names if c != "number"]
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(where["sequence"][k] + number - where["first"][k]), pa.array(where["offset"][k])], [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number")
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", size: int = SEQUENCE, remember: int = KEPT_PARTS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A null text is empty and still has its closing id 0. Texts longer than a sequence are cut
    into whole sequences and a rest. Repeated rows are packed as often as they come.
    """
    cut = stored(pieces(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, size=size, remember=remember).drop("ids"), "pieces")
    return pack(cut, size=size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
