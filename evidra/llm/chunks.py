"""Splitting texts where no tokenizer piece can span, so that each distinct chunk is encoded once in a slice, and frequent ones
once per worker.

A single space between two characters that are not white space always begins a piece of the byte-level patterns:
a piece holds a space only as its first character or within a run of white space. Cutting before such spaces leaves
the pieces, and so the ids, as they are.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space but the plain space, as a character class: all that Python's ``str.isspace`` knows.
OTHER = r"\t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space beside other white space: such texts are cut by a pattern of Python's, all others at each space.
ODD = f" [ {OTHER}]|[{OTHER}] "
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Chunks that a worker remembers, and the most characters of each; beyond them the least used half is forgotten, and
#: longer chunks are encoded anew in each slice. Both bound memory only, never the result.
REMEMBERED, LONGEST = 600_000, 48


class ChunkEncoder:
    """encode: from new chunks to all their ids in order and the number of each chunk's ids."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.first: dict[str, int] = {}  # chunks at a text's beginning
        self.rest: dict[str, int] = {}  # chunks after a space, without it
        self.flat = np.empty(0, np.uint32)
        self.lengths = self.uses = np.empty(0, np.int64)

    def _trim(self) -> None:
        least = np.median(self.uses)
        numbers = []
        for name in ("first", "rest"):
            kept = [(c, n) for c, n in getattr(self, name).items() if self.uses[n] > least]
            setattr(self, name, dict(zip((c for c, _ in kept), range(len(numbers), len(numbers) + len(kept)), strict=True)))
            numbers += [n for _, n in kept]
        keep = np.array(numbers, np.int64)
        self.flat, _ = spread(self.flat, (np.cumsum(self.lengths) - self.lengths)[keep], self.lengths[keep])
        self.lengths, self.uses = self.lengths[keep], self.uses[keep] // 2

    def _numbers(self, known: dict[str, int], prefix: str, pieces: list[str], new: list[str]) -> np.ndarray:
        """The number of each of the distinct pieces; those not yet known are added to ``new``."""
        found = np.fromiter(map(known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0)
        found[missing] = np.arange(len(missing)) + len(self.lengths) + len(new)
        for k in missing.tolist():
            piece = pieces[k]
            new.append(prefix + piece)
            if len(piece) <= LONGEST:
                known[piece] = len(self.lengths) + len(new) - 1
        return found

    def __call__(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order as uint32, and where each text's ids begin, with their end at last."""
        if len(self.lengths) > self.remembered or len(self.flat) > 16 * self.remembered:
            self._trim()
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = pc.match_substring_regex(column, ODD)
        is_odd = odd.to_numpy(zero_copy_only=False)
        split = pc.split_pattern(column.filter(pc.invert(odd)), " ")
        pieces = split.flatten().dictionary_encode()
        counts = np.zeros(len(column), np.int64)
        counts[~is_odd] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        at, words = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
        head = np.zeros(len(at), bool)
        head[(np.cumsum(counts[~is_odd]) - counts[~is_odd])] = True
        new: list[str] = []
        chosen = np.empty(len(at), np.int64)
        number = np.empty(len(words), np.int64)
        for where, known, prefix in ((head, self.first, ""), (~head, self.rest, " ")):
            distinct = np.flatnonzero(np.bincount(at[where], minlength=len(words)))
            number[distinct] = self._numbers(known, prefix, [words[k] for k in distinct.tolist()], new)
            chosen[where] = number[at[where]]
        if is_odd.any():
            cut = [CUT.split(text) for text in column.filter(odd).to_pylist()]
            distinct_pieces = {piece: k for k, piece in enumerate(dict.fromkeys(itertools.chain.from_iterable(cut)))}
            number = self._numbers(self.first, "", list(distinct_pieces), new)
            counts[is_odd] = [len(x) for x in cut]
            chosen = np.concatenate([chosen, number[[distinct_pieces[piece] for piece in itertools.chain.from_iterable(cut)]]])
            # Pieces of the odd texts come after all others; each text's are put where the text is.
            order = np.concatenate([np.flatnonzero(~is_odd), np.flatnonzero(is_odd)])
            starts = np.empty(len(column), np.int64)
            starts[order] = np.cumsum(counts[order]) - counts[order]
            chosen, _ = spread(chosen, starts, counts)
        if new:
            flat, lengths = self.encode(new)
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32, copy=False)])
            self.lengths = np.concatenate([self.lengths, lengths])
        self.uses = np.bincount(chosen, minlength=len(self.lengths)) + np.concatenate([self.uses, np.zeros(len(self.lengths) - len(self.uses), np.int64)])
        ids, ends = spread(self.flat, (np.cumsum(self.lengths) - self.lengths)[chosen], self.lengths[chosen])
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows that hold about ``most`` bytes of one column, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield batch.slice(i, j - i)
        i = j


def joinable(chunk: str) -> bool:
    """Whether a chunk may stand between others without a change of its pieces."""
    return len(chunk) > 1 and chunk[0] == " " and not chunk[1].isspace() and not chunk[-1].isspace()


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` one after another, and the end of each."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0], ends
    at = np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])
    return flat[at], ends
