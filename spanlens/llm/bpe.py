"""Token ids of whole texts by a public `tokenizers` file, one encoding per distinct unit.

A byte-level BPE file splits a text into pre-tokens first and merges bytes only inside
them.  A single space or newline between two non-blank characters always starts a
pre-token, so a text may be cut there and the parts encoded on their own: the ids are
those of the whole text.  Parts repeat a lot, so each is encoded once per worker and kept
(little-endian unsigned 32-bit ids as bytes) in a bounded table.

Special-token strings in a text are ordinary text.  A null or empty text has no ids.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # a contraction may begin with an apostrophe
_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def public_file(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None, max_units: int = 500_000) -> UnitEncoder:
    """The encoder of this worker process for a file (a name without a folder is a public file)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    name = path or "byte_bpe_50k.json"
    name = name if os.sep in name else public_file(name)
    key = (name, max_units)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(name, max_units)
    return _ENCODERS[key]


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte inside a byte-level BPE vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class _Units(dict):
    """Ids of parts by their strings, encoded when first asked for; past the bound the younger half goes.

    A part of letters only, or of ASCII digits only, is one pre-token and goes to the BPE model directly;
    trailing marks (no apostrophe) are a pre-token of their own.
    """

    def __init__(self, tokenizer, prefix: str, max_units: int, bare: _Units | None = None):
        super().__init__()
        self.tokenizer, self.prefix, self.max_units, self.bare = tokenizer, prefix, max_units, bare
        letters = _byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.model = tokenizer.model

    def _new(self, unit: str) -> bytes:
        if unit.isalpha() or (unit.isdigit() and unit.isascii()):
            raw = (self.prefix + unit).encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
        if self.bare is not None:
            if unit[:1] == "\n":
                return self.bare["\n"] + self.bare[unit[1:]] if len(unit) > 1 else self.bare["\n"]
            core = unit.rstrip(_MARKS)
            if core != unit and (core.isalpha() or (core.isdigit() and core.isascii())):
                return self[core] + self.bare[unit[len(core) :]]
        surface = self.prefix + unit
        return array("I", self.tokenizer.encode(surface, add_special_tokens=False).ids).tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self._new(unit)
        if len(unit) <= 64:
            if len(self) >= self.max_units:
                kept = list(islice(self.items(), self.max_units // 2))
                self.clear()
                self.update(kept)
            self[unit] = ids
        return ids


class UnitEncoder:
    """Encodes texts to bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, max_units: int = 500_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The file's own part, not the whole vocabulary as Python objects.
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer is not None else {}
        self.byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.bare = _Units(self.tokenizer, "", max_units // 4)
        self.after_space = _Units(self.tokenizer, " ", max_units, self.bare)

    def encode(self, text: str | None) -> bytes:
        """Ids of one text."""
        return self.encode_block([text])[0].tobytes()

    def encode_block(self, texts: list[str | None]):
        """(ids of all texts one after another, where each text's ids begin and the end) as numpy arrays.

        Plain texts are cut at every blank and each distinct part is looked up once; in the others only the
        cuts that are always safe are made.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = [bool(t) and self.byte_level and _plain(t) for t in texts]
        parts = pc.split_pattern(pa.array([t.replace("\n", " \n") for t, p in zip(texts, plain, strict=True) if p], pa.large_string()), " ")
        bounds = np.asarray(parts.offsets, dtype=np.int64)
        coded = parts.flatten().dictionary_encode()
        blobs = list(map(self.after_space.__getitem__, coded.dictionary.to_pylist()))
        codes = np.asarray(coded.indices, dtype=np.int64)
        n = len(blobs)
        # The first part of a text has no space before it, and an odd text is one part of its own.
        firsts = [self.bare[t[: len(t.split(" ", 1)[0].split("\n", 1)[0])]] for t, p in zip(texts, plain, strict=True) if p]
        if len(firsts):
            codes[bounds[:-1]] = n + np.arange(len(firsts))
        odd = [b"" if not t else self._odd(t) for t, p in zip(texts, plain, strict=True) if not p]
        blobs += firsts + odd
        lens = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts = np.concatenate([[0], np.cumsum(lens)])
        pool = np.frombuffer(b"".join(blobs), dtype="<u4")
        if odd:
            per_text, k, m, chunks = [], 0, 0, []
            for p in plain:
                if p:
                    chunks.append(codes[bounds[k] : bounds[k + 1]])
                    k += 1
                else:
                    chunks.append(np.array([n + len(firsts) + m]))
                    m += 1
                per_text.append(len(chunks[-1]))
            codes = np.concatenate(chunks)
            bounds = np.concatenate([[0], np.cumsum(per_text)])
        size = lens[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = pool[:0]
        if len(codes):
            # Places as narrow as they can be, added in place: they are the largest arrays here.
            kind = np.int32 if max(len(pool), int(ends[-1])) < 2**31 else np.int64
            place = np.arange(ends[-1], dtype=kind)
            place += np.repeat((starts[codes] - ends[:-1]).astype(kind), size)
            ids = pool.take(place)
        return ids, ends[bounds] if len(codes) else np.zeros(len(texts) + 1, np.int64)

    def _odd(self, text: str) -> bytes:
        if not self.byte_level:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.bare.__getitem__, _SAFE_CUT.split(text)))

    def blocks(self, texts: list[str | None], max_chars: int = 8_000_000):
        """encode_block over runs of texts of bounded size: (first index, ids, bounds)."""
        at = 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and (end == at or n + len(texts[end] or "") <= max_chars):
                n += len(texts[end] or "")
                end += 1
            yield (at, *self.encode_block(texts[at:end]))
            at = end


# The white space of str.split() other than space and newline, and pairs of blanks.
_OTHER_BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHER_BLANK = re.compile(f"[{_OTHER_BLANKS}]")
_BLANK_PAIRS = ("  ", " \n", "\n ", "\n\n")


def _plain(text: str) -> bool:
    """Whether every blank is one space or newline between two other characters."""
    if text[0] in " \n" or text[-1] in " \n":
        return False
    return not any(p in text for p in _BLANK_PAIRS) and not _OTHER_BLANK.search(text)
