"""Token ids by the tokenizers library, one call per distinct stretch of text instead of one per document.

A text is cut only where the tokenizer's own pre-tokenizer always cuts (before the space that leads a word, or at
white space that is dropped), so the ids of the stretches joined are the ids of the text. A text that holds the
string of an added token, and any tokenizer whose cuts are not known here, is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

# Fixed value: the characters of Unicode's White_Space property.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LED = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_BARE = re.compile(rf"[^{_WHITE}]+")
_PLAIN = re.compile(r"( ?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?*#$%&|)]*)\Z")
# The byte alphabet of byte-level tokenizers: printable bytes stand for themselves, the others follow from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {x: 256 + i for i, x in enumerate(x for x in range(256) if x not in _SHOWN)}
_OPEN: dict[str, Encoder] = {}


def _gaps(values: list) -> list[int]:
    """Places of None."""
    out, j = [], -1
    try:
        while True:
            out.append(j := values.index(None, j + 1))
    except ValueError:
        return out


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; keeps two generations of at most `limit` stretches in memory."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.cut, self.between = None, ""
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.cut, self.between = _LED, "\n"
        elif pre.get("type") == "Sequence" and any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and r"[^\s\p{L}\p{N}]+" in (p.get("pattern") or {}).get("Regex", "") for p in pre["pretokenizers"]):
            self.cut, self.between = _BARE, " \u2603 "
        self.folds = "Lowercase" in json.dumps(spec.get("normalizer") or {})
        self.between_ids = self._ids([self.between])[0] if self.cut else b""

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, stretches: list[str]) -> list[bytes]:
        """The ids of stretches that are not white space: encoded in a row, with a known separator between them."""
        ids = self._ids([self.between.join(stretches)])[0]
        marks, flat = np.frombuffer(self.between_ids, "<u4"), np.frombuffer(ids, "<u4")
        hit = flat[: len(flat) - len(marks) + 1] == marks[0]
        for k in range(1, len(marks)):
            hit &= flat[k : len(flat) - len(marks) + 1 + k] == marks[k]
        at = np.flatnonzero(hit)
        if len(at) != len(stretches) - 1:
            return self._ids(stretches)
        starts, ends = [0, *(4 * (at + len(marks))).tolist()], [*(4 * at).tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(starts, ends, strict=True)]

    def _learn(self, new: set[str]) -> None:
        """Ids of stretches that are not in memory; Latin letters, with or without punctuation after them, go straight to the model."""
        memo, older = self.memo, self.older
        if len(memo) > self.limit:
            self.older, self.memo = older, memo = memo, {}
        solid, white, tokenize, folds = [], [], self.tokenizer.model.tokenize, self.folds
        for c in new:
            if older and (known := older.get(c)) is not None:
                memo[c] = known
                continue
            m = _PLAIN.match(c)
            if m is None:
                (white if c.isspace() else solid).append(c)
                continue
            # letters are one word to the pre-tokenizer, and so is the punctuation after them; a leading space is a byte of the word
            space, word, tail = m.groups()
            if folds:
                word = word.lower()
            key = space + word
            ids = memo.get(key)
            if ids is None:
                shown = ("\u0120" + word if space else word) if word.isascii() else key.encode().decode("latin-1").translate(_BYTES)
                ids = memo[key] = array("I", [t.id for t in tokenize(shown)]).tobytes()
            if tail:
                end = memo.get(tail)
                if end is None:
                    end = memo[tail] = self._ids([tail])[0]
                ids += end
            memo[c] = ids
        memo.update(zip(white, self._ids(white), strict=True))
        for k in range(0, len(solid), 500):
            memo.update(zip(solid[k : k + 500], self._joined(solid[k : k + 500]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        texts = [t or "" for t in texts]
        plain = [self.cut is not None and not any(a in t for a in self.added) for t in texts]
        parts = [self.cut.findall(t) if p else None for t, p in zip(texts, plain, strict=True)]
        look = self.memo.get
        found = [list(map(look, p)) if p is not None else None for p in parts]
        gaps = [_gaps(v) if v is not None else [] for v in found]
        new = {p[j] for p, g in zip(parts, gaps, strict=True) for j in g}
        if new:
            self._learn(new)
            look = self.memo.__getitem__
            for p, v, g in zip(parts, found, gaps, strict=True):
                for j in g:
                    v[j] = look(p[j])
        return [b"".join(v) if v is not None else self._ids([t])[0] for t, v in zip(texts, found, strict=True)]


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
