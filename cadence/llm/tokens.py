"""Token ids by the tokenizers library, computed once for each distinct chunk of text.

A chunk ends before a space that stands between two other characters. The byte-level
pre-tokenizer never joins characters across such a place, so a text's ids are its chunks' ids
in a row. Chunks repeat far more than texts: each worker keeps the ids of chunks it has met (a
bounded table, first come) and sends only unknown ones to the library, joined, in one call.
Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np

END_ID = 0
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BLANKS = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_POINTS = frozenset(".,;:!?|")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _beside_space(text: str) -> bool:
    """Whether white space stands beside a space."""
    return "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in _BLANKS)


def _chunks(text: str) -> tuple[list[str], str]:
    """The chunks that follow a single space each, and what stands before the first of them."""
    if not text:
        return [], ""
    if text[0] == " " or text[-1] == " " or _beside_space(text) or (not text.isascii() and _WIDE.search(text)):
        parts = _SPLIT.split(text)
    else:
        parts = text.split(" ")  # every space stands between two other characters
    lead = parts.pop(0)
    return parts, lead


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str | None = None, keep: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or default_path())
        self.library.encode_special_tokens = True
        self.size = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, at in self.library.get_vocab().items():
            self.size[at] = len(token)  # one character of the byte-level alphabet is one byte
        self.keep = keep
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without the end id."""
        collecting = gc.isenabled()
        gc.disable()  # no cycles arise here, and the many small objects would set collections off
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        get = self.known.get
        rows: list[tuple[str, list]] = []
        holes: list[tuple[list, int, str]] = []
        for text in texts:
            rest, lead = _chunks(text)
            ids = list(map(get, rest))
            if None in ids:
                holes += [(ids, k, rest[k]) for k, v in enumerate(ids) if v is None]
            rows.append((lead, ids))
        if holes:
            fresh = self._after_space({h[2] for h in holes})
            for ids, k, chunk in holes:
                ids[k] = fresh[chunk]
            if len(self.known) + len(fresh) <= self.keep:
                self.known.update(fresh)
        leads = list({lead for lead, _ in rows if lead})
        alone = self._alone(leads)
        return [(alone[lead] if lead else b"") + b"".join(ids) for lead, ids in rows]

    def _after_space(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of each chunk behind its space. A word before a closing mark shares the bare word's ids."""
        out: dict[str, bytes] = {}
        known = self.known
        bare: set[str] = set()
        cut: list[str] = []
        for c in chunks:
            if c[-1] in _POINTS and len(c) > 1 and c[-2].isalpha():
                cut.append(c)
                if c[:-1] not in known and c[:-1] not in chunks:
                    bare.add(c[:-1])
            else:
                bare.add(c)
        bare = list(bare)
        joint = [c for c in bare if c.strip() == c]
        odd = [c for c in bare if c.strip() != c] if len(joint) < len(bare) else []
        out.update(self._joined(joint))
        if odd:
            out.update(zip(odd, self._alone([f" {c}" for c in odd]).values(), strict=True))
        if cut:
            marks = self._alone(list({c[-1] for c in cut}))
            for c in cut:
                word = c[:-1]
                out[c] = (out.get(word) or known[word]) + marks[c[-1]]
        return out

    def _joined(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that neither start nor end in white space, a space before each."""
        out: dict[str, bytes] = {}
        groups = [chunks[i : i + 400] for i in range(0, len(chunks), 400)]
        for group, got in zip(groups, self.library.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype="<u4")
            ends = np.cumsum([len(c.encode()) + 1 for c in group])
            cut = (4 * np.searchsorted(np.cumsum(self.size[ids]), ends) + 4).tolist()
            raw = ids.tobytes()
            out.update(zip(group, map(raw.__getitem__, map(slice, [0, *cut], cut)), strict=True))
        return out

    def _alone(self, chunks: list[str]) -> dict[str, bytes]:
        got = self.library.encode_batch_fast(chunks, add_special_tokens=False)
        return {c: np.array(g.ids, dtype="<u4").tobytes() for c, g in zip(chunks, got, strict=True)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = path or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    return _ENCODERS[key]


def with_end(ids: bytes) -> bytes:
    return ids + END_ID.to_bytes(4, "little")
