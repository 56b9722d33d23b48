"""Token counts by prefix dynamic programming over a byte-pair vocabulary.

A byte-pair encoding of a piece of text is valid exactly when every two neighbouring tokens
are what the merges make of their joined bytes, and each prefix of the piece has one valid
last token. So for each prefix, in order of length, the longest token that ends there and
follows the last token of the remaining prefix closes it: count[i] = count[i - len] + 1.
The table of a piece answers every prefix of it; the table of a text is the running sum over
its pieces. Pieces repeat, so each task keeps the tables of the pieces it met (bounded).
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carepath.llm.common import valid

#: Fixed value: the pieces that byte_bpe_50k.json cuts a text into (the ByteLevel pattern).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Up to here the pattern and the library agree on the class of every code point; texts with later ones are cut by the library.
PLAIN = regex.compile(r"[\x00-\u052F]*")
#: Pieces and words with their blank that a task remembers before it begins anew, and the longest kept.
KEPT_PIECES, KEPT_CHUNKS, KEPT_CHARS = 800_000, 300_000, 64
#: Blanks that the short way through a text does not take: those other than one space or one line end.
UNEVEN = ("\t", "\x0b", "\x0c", "\r", "\x85", "\xa0", "  ", " \n", "\n ", "\n\n")
#: Tokens of a document before it counts as over the limit.
LIMIT = 512


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts at every prefix, for one byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in byte_letters().items()}
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        # numbered by merge: the 256 bytes, then what each merge makes; a byte splits into itself
        number = {c: b for c, b in byte_of.items()}
        self.split, self.merged = [(b, b) for b in range(256)], {}
        for left, right in spec["model"]["merges"]:
            pair = number[left], number[right]
            self.merged[pair] = number[left + right] = len(self.split)
            self.split.append(pair)
        self.id_of = {as_bytes(t): n for t, n in number.items()}
        ends: dict[bytes, set[int]] = {}
        for token in self.id_of:
            if len(token) > 2:
                ends.setdefault(token[-3:], {1, 2}).add(len(token))
        self.sizes = {end: tuple(sorted(found, reverse=True)) for end, found in ends.items()}  # of tokens that end so
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self._follows: dict[int, bool] = {}
        self._kept: dict[str, int] = {}
        self._chunks: dict[str, int] = {}  # of words after a blank

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        Undoes the merges at the border, newest first; a merge across it that came earlier than
        the one undone last would have been made instead. Tokens are numbered by merge.
        """
        a, b, bound, known = left, right, len(self.split) + 1, None
        while True:
            if self.merged.get((a, b), bound) < bound:
                known = False
                break
            if a > b:
                bound, a = a, self.split[a][1]
                if a == bound:
                    bound, b = b + 1, self.split[b][0]
                    known = True if b + 1 == bound else None
            else:
                bound, b = b + 1, self.split[b][0]
                if b + 1 == bound:
                    bound, a = a, self.split[a][1]
                    known = True if a == bound else None
            if known:
                break
        if len(self._follows) > 1_000_000:
            self._follows.clear()
        self._follows[left << 20 | right] = known
        return known

    def table(self, piece: bytes) -> list[int]:
        """count[i]: tokens of the first i bytes of a piece."""
        n, id_of, sizes, follows = len(piece), self.id_of, self.sizes, self._follows
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for size in sizes.get(piece[i - 3 : i]) or (2, 1) if i > 2 else (i, 1):
                if size > i:
                    continue
                token = id_of.get(piece[i - size : i])
                if token is None:
                    continue
                if size != i:
                    before = last[i - size]
                    if (known := follows.get(before << 20 | token)) is None:
                        known = self._may_follow(before, token)
                    if not known:
                        continue
                last[i], count[i] = token, count[i - size] + 1
                break
        return count

    def _piece(self, piece: str) -> int:
        if (known := self._kept.get(piece)) is None:
            known = self.table(piece.encode())[-1]
            if len(piece) <= KEPT_CHARS:
                if len(self._kept) >= KEPT_PIECES:
                    self._kept.clear()
                self._kept[piece] = known
        return known

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and those (True), which are one token each."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def _cut(self, text: str) -> list[str]:
        if text.isascii() or PLAIN.fullmatch(text):
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.cut(text)]

    def pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """(piece, its tokens) in order."""
        for part, special in self._parts(text):
            if special:
                yield part, 1
            else:
                yield from ((p, self._piece(p)) for p in self._cut(part))

    def count(self, text: str) -> int:
        """The last entry of the text's prefix table."""
        if self._special and self._special.search(text):
            return sum(n for _, n in self.pieces(text))
        if not PLAIN.fullmatch(text) or any(x in text for x in UNEVEN) or text[:1].isspace() or text[-1:].isspace():
            return sum(map(self._piece, self._cut(text)))
        # one blank between words: each part with its blank is cut on its own, and each line end is a token
        total, got = text.count("\n"), self._chunks.get
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            total += self._chunk(first)
            for c in rest:
                if (n := got(c)) is None:
                    n = self._chunk(" " + c, c)
                total += n
        return total

    def _chunk(self, chunk: str, name: str | None = None) -> int:
        n = sum(map(self._piece, PIECES.findall(chunk)))
        if name is not None and len(name) <= KEPT_CHARS:
            if len(self._chunks) >= KEPT_CHUNKS:
                self._chunks.clear()
            self._chunks[name] = n
        return n

    def _within(self, text: str, start: int, piece: str, before: int, back: tuple[int, int]) -> list[int]:
        """The exact token count of text[: start + j] for j from 1 to the length of the piece there.

        A prefix of a run is one piece again, so the run's own table answers it. Only a prefix that
        ends in its leading blank, in a contraction or in a special string is cut otherwise, and
        with what stands before it: those few are counted from `back`, the start of the piece
        before and the tokens up to there.
        """
        anew = lambda j: back[1] + self.count(text[back[0] : start + j])
        if piece in self.specials or (piece[0] == "'" and len(piece) > 1 and piece[1].isalpha()):
            return [*map(anew, range(1, len(piece))), before + (1 if piece in self.specials else self._piece(piece))]
        table = self.table(piece.encode())
        ends = range(1, len(piece) + 1) if piece.isascii() else accumulate(len(c.encode()) for c in piece)
        out = [before + table[end] for end in ends]
        if piece[0].isspace():
            out[0] = anew(1)
        return out

    def _places(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """The pieces, where each starts, and the tokens before each (and after the last)."""
        pieces = [*self.pieces(text)]
        return [p for p, _ in pieces], [0, *accumulate(len(p) for p, _ in pieces)], [0, *accumulate(n for _, n in pieces)]

    def prefixes(self, text: str) -> list[int]:
        """The exact token count of text[:k] for every k from 0 to its length: the text's prefix table."""
        pieces, starts, before = self._places(text)
        out = [0]
        for k, piece in enumerate(pieces):
            back = max(0, k - 1)
            out += self._within(text, starts[k], piece, before[k], (starts[back], before[back]))
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """The most code points of the text whose exact count is within the budget, from the tables of the pieces at the border."""
        pieces, starts, before = self._places(text)
        if before[-1] <= budget:
            return len(text)
        # what stands before the piece before it is whole in every prefix and leaves one token at least
        for k in range(min(bisect_left(before, budget), len(pieces) - 1), -1, -1):
            back = max(0, k - 1)
            counts = self._within(text, starts[k], pieces[k], before[k], (starts[back], before[back]))
            if (j := next((j for j in range(len(counts), 0, -1) if counts[j - 1] <= budget), 0)) > 0:
                return starts[k] + j
        return 0


@lru_cache(maxsize=2)
def counter(name: str) -> PrefixCounter:
    """One per Python worker; `name` is a vocabulary file of the public_tokenizers package or a path."""
    import public_tokenizers

    return PrefixCounter(name if "/" in name else public_tokenizers.path(name))


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars of every row, from whole texts.

    fit_chars is the longest prefix in code points within `limit` tokens; of equally good ones
    there is none, as prefixes differ in length. A null text counts as empty (0 tokens), and what
    is no UTF-8 in a text as U+FFFD. Time grows with the length of a text, be it one line or one
    word. Repeated rows and null ids come back as they are, an empty table gives no row, and other
    columns are not looked at. One pass without a shuffle; a task keeps one batch and a bounded
    table of pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = [tokens.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                    pa.array([tokens.longest_prefix(t, limit) if n > limit else len(t) for t, n in zip(texts, counts, strict=True)], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), valid(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and counts: the exact token count of every code-point prefix, from none to the whole text.

    The stored table answers any truncation (`counts[k]`) or budget question (`fitting`) by a look
    at the array. Nulls, repeats and empty tables as for `token_counts`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens.prefixes(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "counts"])

    rows = docs.select(F.col(id_col).alias("doc_id"), valid(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, counts array<int>")


def fitting(counts: Column, budget: Column) -> Column:
    """The most code points within the budget, by a prefix table."""
    return F.array_max(F.transform(counts, lambda n, k: F.when(n <= budget, k)))
