"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once per worker."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

from gondola.llm.common import CACHES, WHITE, lower_ascii, slices, text_bytes

#: A worker keeps the ids of so many distinct pieces, or of pieces of so many bytes; beyond either it keeps those seen again.
CACHE_PIECES, CACHE_BYTES = 400_000, 16 << 20
#: Bytes of text that are cut and looked up at once.
ENCODE_BYTES = 4 << 20
END_ID = 2

_GRAPH = np.array([33 <= c < 127 for c in range(256)])
_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_PUNCT = np.isin(np.arange(256), list(b'.,;:!?()"/-'))
_ENCODERS: dict[str, PieceEncoder] = {}
CACHES.append(_ENCODERS.clear)


def _odd_spaces(data: np.ndarray) -> bool:
    """Whether a white space beyond ASCII may stand in UTF-8 bytes."""
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    at = at[at < len(data) - 1]
    lead, second = data[at], data[at + 1]
    return bool((((lead == 0xC2) & ((second == 0x85) | (second == 0xA0))) | ((lead == 0xE1) & (second == 0x9A)) | ((lead == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((lead == 0xE3) & (second == 0x80))).any())


class PieceEncoder:
    """Encodes slices of texts piece by piece, to the same ids as whole texts by the untouched tokenizer.

    A vocabulary that drops white space starts a new word at any. A byte-level one always splits before a space that
    follows a visible character, and before one that stands between white space and a visible character; other spaces stay
    inside a piece, and so does one between white space and what may be a special token.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))
        self.spaced = not name.rpartition(os.sep)[2].startswith("word_")
        self.mark_text = b" \x01"
        self.mark_ids = self.tokenizer.encode(self.mark_text.decode(), add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        #: Place of each known piece; its ids are ids[starts[place] : starts[place + 1]].
        self.known: dict[bytes, int] = {}
        self.known_bytes = self.used = 0
        self.starts, self.ids, self.seen = np.zeros(1024, np.int64), np.zeros(4096, np.int32), np.zeros(1024, np.int32)

    def _shrink(self) -> None:
        """Forget what only one slice has held since it was learnt; if that is little, everything."""
        known, starts, ids, again = self.known, self.starts, self.ids, self.seen > 1
        self._clear()
        kept = [p for p, k in known.items() if again[k]]
        if 2 * len(kept) > len(known):
            return
        places = np.array([known[p] for p in kept], np.int64)
        size = starts[places + 1] - starts[places]
        before = np.cumsum(size) - size
        self._keep(kept, ids[np.repeat(starts[places] - before, size) + np.arange(int(size.sum()))], size)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces may start: before white space as said above, after a single line feed or the like, and between ASCII
        letters or digits and some punctuation."""
        white, alnum, punct = WHITE[data], _ALNUM[data], _PUNCT[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (alnum[:-1] & punct[1:]) | (punct[:-1] & alnum[1:])
        if not self.spaced:
            return cut | white
        at = np.flatnonzero(white)
        graph = _GRAPH if _odd_spaces(data) else _GRAPH | (np.arange(256) >= 128)
        last = np.zeros(len(data) + 1, bool)
        last[offsets] = True
        after = data[np.minimum(at + 1, len(data) - 1)]
        seen = graph[after] & (after != 60) & ~last[at + 1]
        cut[at[graph[data[np.maximum(at - 1, 0)]] | seen]] = True
        cut[at[seen & (data[at] != 32)] + 1] = True
        return cut

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that start with a space, from one joined text, and how many each has. After each piece stands a
        mark, a byte that none of them holds and no merge of the vocabulary joins; a space keeps it apart."""
        joined = self.tokenizer.encode_batch_fast([(self.mark_text.join(pieces) + self.mark_text).decode()], add_special_tokens=False)[0].ids
        ids = np.array(joined, np.int32)
        marks = np.flatnonzero(ids == self.mark_ids[-1])
        keep = np.ones(len(ids), bool)
        for back in range(len(self.mark_ids)):
            keep[marks - back] = False
        return ids[keep], np.diff(marks, prepend=-1) - len(self.mark_ids)

    def _learn(self, new: list[bytes]) -> None:
        simple = [p for p in new if p[:1] == b" " and b"<|" not in p and b"\x01" not in p]
        others = list(set(new).difference(simple)) if len(simple) < len(new) else []
        for k in range(0, len(simple), 4096):
            self._keep(simple[k : k + 4096], *self._ids(simple[k : k + 4096]))
        for k in range(0, len(others), 4096):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in others[k : k + 4096]], add_special_tokens=False)]
            self._keep(others[k : k + 4096], np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64))

    def _keep(self, part: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        place, total = len(self.known), len(ids)
        while place + len(part) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[place + 1 : place + len(part) + 1] = self.used + np.cumsum(n)
        self.ids[self.used : self.used + total] = ids
        self.used += total
        self.known.update(zip(part, range(place, place + len(part)), strict=True))
        self.known_bytes += sum(map(len, part))

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_PIECES or self.known_bytes > CACHE_BYTES:
            self._shrink()
        self._learn([p for p in pieces if p not in self.known])
        found = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self.seen[found] += 1
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in data, one after the other, each with the end id if there is one; and the texts' limits."""
        n = len(offsets) - 1
        if not self.spaced and not ((data[:-1] == 60) & (data[1:] == 124)).any():
            data = lower_ascii(data)  # the vocabulary lower-cases all letters, but not those of a special token
        # A piece reaches from one cut, or a text's start, to the next.
        first = np.zeros(len(data) + 1, bool)
        first[:-1] = self._cuts(data, offsets)
        first[offsets] = True
        at = np.flatnonzero(first)
        del first
        if len(data) == 0:
            at = np.zeros(1, np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        cut = np.searchsorted(at, offsets)
        del at
        place = self._places(pieces.dictionary.to_pylist())[np.asarray(pieces.indices)] if len(pieces) else np.zeros(0, np.int64)
        del pieces
        start, size = self.starts[place], self.starts[place + 1]
        size -= start
        del place
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        start -= upto[:-1]
        source = np.repeat(start, size)
        del start, size
        source += np.arange(len(source))
        own, limits = self.ids[source], upto[cut]
        if end_id is None:
            return own, limits
        # One more place after each text for the end id.
        limits += np.arange(n + 1)
        out = np.full(len(own) + n, end_id, np.int32)
        inside = np.ones(len(out), bool)
        inside[limits[1:] - 1] = False
        out[inside] = own
        return out, limits


def encoder(name: str) -> PieceEncoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(name)
    return _ENCODERS[name]


def encoded(batch: pa.RecordBatch, vocabulary: str, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch's `text` column as (first row, last row, ids, limits); null as empty."""
    offsets, data = text_bytes(batch.column("text"))
    for a, e in slices(offsets, ENCODE_BYTES):
        yield a, e, *encoder(vocabulary).encode(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a], end_id)
