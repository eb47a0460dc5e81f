"""Encoding with the tokenizers library, each distinct chunk once per worker."""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from evidra.llm.chunks import REMEMBERED, ChunkEncoder, joinable

#: Chunks encoded as one string, and strings encoded by one call: the library holds these with more than their ids.
JOINED, TOGETHER = 2000, 100
#: The bit that says that an id is the last of a piece.
STOP = np.uint32(1 << 31)


def open_tokenizer(data: bytes) -> Tokenizer:
    """The tokenizer of a file's bytes, without truncation or padding, for use by a task that has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for.

    Bytes that are printable characters of Latin-1 stand for themselves, the others for the characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)).difference(printable))
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def token_table(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer; ids that it doesn't have are empty."""
    byte_of = byte_characters()
    vocab = tokenizer.get_vocab()
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    out = [b""] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        # An added token is text as it stands.
        out[k] = token.encode() if token in added else bytes(map(byte_of.__getitem__, token))
    return out


class LibraryEncoder:
    """A byte-level tokenizer file's ids, as ``encode(text, add_special_tokens=False)`` gives them.

    The strings of special tokens in a text become their ids, as the library does by default; with ``plain`` they are
    ordinary text. No such string may hold a space. With ``stops`` the last id of each of the pattern's pieces has the
    bit ``STOP`` set.
    """

    def __init__(self, data: bytes, plain: bool = False, stops: bool = False, remembered: int = REMEMBERED):
        self.tokenizer, self.stops = open_tokenizer(data), stops
        self.tokenizer.encode_special_tokens = plain
        self.tokens = token_table(self.tokenizer)
        self.size = len(self.tokens)
        self.token_bytes = np.fromiter(map(len, self.tokens), np.int64, self.size)
        self.chunks = ChunkEncoder(self.encode_chunks, remembered)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each text's ids."""
        ids: list[np.ndarray] = [np.empty(0, np.uint32)]
        encode = self.tokenizer.encode_batch if self.stops else self.tokenizer.encode_batch_fast
        for i in range(0, len(texts), TOGETHER):
            for x in encode(texts[i : i + TOGETHER], add_special_tokens=False):
                ids.append(np.array(x.ids, np.uint32))
                if self.stops:
                    ids[-1][np.diff(np.array(x.word_ids, np.int64), append=-1) != 0] |= STOP
        return np.concatenate(ids), np.fromiter(map(len, ids[1:]), np.int64, len(ids) - 1)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks in order, and the number of each chunk's ids."""
        whole = np.fromiter(map(joinable, chunks), bool, len(chunks))
        sizes = np.zeros(len(chunks), np.int64)
        together = list(itertools.compress(chunks, whole))
        joined, _ = self._ids(["".join(together[i : i + JOINED]) for i in range(0, len(together), JOINED)])
        # The bytes of the ids tell which ids are of which chunk.
        bounds = np.cumsum(pc.binary_length(pa.array(together, pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.searchsorted(np.cumsum(self.token_bytes[joined & ~STOP]), bounds, side="left") + 1
        sizes[whole] = np.diff(ends, prepend=0)
        alone, sizes[~whole] = self._ids(list(itertools.compress(chunks, ~whole)))
        flat, of_whole = np.empty(int(sizes.sum()), np.uint32), np.repeat(whole, sizes)
        flat[of_whole], flat[~of_whole] = joined, alone
        return flat, sizes

    def encode(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.chunks(texts)


@functools.lru_cache(1)
def library_encoder(data: bytes, plain: bool = False, stops: bool = False, remembered: int = REMEMBERED) -> LibraryEncoder:
    """One encoder for all tasks of a Python worker."""
    return LibraryEncoder(data, plain, stops, remembered)
