"""Token ids of whole texts by a public tokenizer file, encoded chunk by chunk with a bounded cache.

Both vocabularies cut a text at white space, and between a letter and ASCII punctuation, before
anything else, so the ids of a text are the ids of its chunks in a row. One file drops white space and
case; the byte-level one keeps white space with the word that follows. Chunks repeat a lot, so most are
looked up rather than encoded.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Unicode's White_Space property (fixed value): a chunk starts where it follows other characters.
SPACE_CLASS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER = "0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
MARK = r"!-/:-@\[-`{-~"
KEPT = re.compile(f"[{SPACE_CLASS}]*[{LETTER}]+(?=[{SPACE_CLASS}{MARK}]|$)|[{SPACE_CLASS}]*[^{SPACE_CLASS}]+|[{SPACE_CLASS}]+")
DROPPED = re.compile(f"[{LETTER}]+(?=[{SPACE_CLASS}{MARK}]|$)|[^{SPACE_CLASS}]+")
SPACED = re.compile(f"[{SPACE_CLASS}](?s:.)*[^{SPACE_CLASS}]$")  # starts with white space and ends with none
CACHE_ROWS, CACHE_CHUNK = 200_000, 48


class Encoder:
    """Encodes to little-endian ids of ``width`` bytes. At most CACHE_ROWS short chunks are kept."""

    def __init__(self, path: str, keeps_space: bool, width: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space, self.kind = keeps_space, f"<u{width}"
        self.known: dict = {}

    def chunks(self, text: bytes) -> list[str]:
        if self.keeps_space:
            return KEPT.findall(text.decode("utf-8", "replace"))
        return DROPPED.findall((text if b"<|" in text else text.lower()).decode("utf-8", "replace"))

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of the chunks that aren't known yet. They are encoded many to a text, since a call costs
        more than a chunk; offsets tell which chunk a token is of. A chunk that could join its
        neighbours there is encoded alone."""
        new = chunks.difference(self.known)
        glue = "" if self.keeps_space else " "
        alone = [c for c in new if "<" in c or self.keeps_space and (not SPACED.match(c))]
        rest = list(new.difference(alone))
        got, width = {}, np.dtype(self.kind).itemsize
        for c, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            got[c] = np.asarray(e.ids, self.kind).tobytes()
        for i in range(0, len(rest), 2000):
            part = rest[i : i + 2000]
            e = self.tokenizer.encode(glue.join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(c) + len(glue) for c in part])
            at = np.searchsorted(np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids)), starts).tolist()
            ids = np.asarray(e.ids, self.kind).tobytes()
            for c, lo, hi in zip(part, at, at[1:]):
                got[c] = ids[lo * width : hi * width]
        return got

    def batches(self, texts: list, most: int = 1_000_000):
        """The ids of each text, as bytes; about ``most`` bytes of text are cut into chunks at a time."""
        held, size = [], 0
        for text in texts:
            held.append(self.chunks(text or b""))
            size += len(text or b"")
            if size > most:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list):
        fresh = set()
        for chunks in held:
            fresh.update(chunks)
        got, known = self.learn(fresh), self.known
        room = CACHE_ROWS - len(known)
        known.update(got)  # one look-up a chunk; those that aren't kept go again
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in held]
        for n, chunk in enumerate(got):
            if n >= room or len(chunk) > CACHE_CHUNK:
                del known[chunk]
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, keeps_space: bool, width: int = 4) -> Encoder:
    """The encoder of this Python worker. It lives on from task to task with what it has learned, which costs
    more than the look-ups; a worker holds one, so another kind takes its place."""
    key = (path, keeps_space, width)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, keeps_space, width)
    return _ENCODERS[key]
