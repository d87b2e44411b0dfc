"""Token ids of whole texts exactly as the tokenizers library gives them, fast.

The library spends most of its time on normalising and splitting, and encodes
every word of a running text anew.  Here numpy splits a batch of texts into the
pieces that the file's pre-tokenizer makes, the library's model encodes each
different piece once, and numpy lays the pieces' ids out again.  Texts with a
character outside a set where both are known to agree, or with the string of a
special token, are left to the library as they are; so are all texts if a file
has another normalizer or pre-tokenizer than the one known here.  Long texts are
cut at white space, so that the memory taken does not grow with them.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from orbweave.llm.common import tool
from orbweave.llm.text_kernels import groups, hash_spans, ragged

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CACHE_PIECES = 1 << 18
#: And so many ids, or those of one group of texts more.
CACHE_IDS = 1 << 21
GROUP_CHARACTERS = 1 << 18
_BREAK = re.compile(r"[ \t\n]")
#: The pre-tokenizer's pattern that `split` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By character below 65536: lower case, class, whether it may be here."""
    lower, kind, safe = np.arange(1 << 16, dtype=np.uint16), np.full(1 << 16, OTHER, np.uint8), np.zeros(1 << 16, bool)
    for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20AD)]:
        s = chr(c)
        safe[c] = len(s.lower()) == 1 and ord(s.lower()) < 0x250 or c >= 0x2010
        if safe[c]:
            lower[c] = ord(s.lower())
        kind[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(s)[0], OTHER)
    kind[[0x20, 0x85, 0xA0, *range(0x09, 0x0E)]] = SPACE
    return lower, kind, safe


LOWER, KIND, SAFE = _tables()


def split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's matches in lower-cased UTF-16 codes."""
    n = len(codes)
    kind = np.zeros(n + 3, np.uint8)
    kind[:n] = KIND[codes]
    start = np.zeros(n + 3, bool)
    start[0] = kind[0] != SPACE
    start[1:] = (kind[1:] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER))
    at = np.flatnonzero((codes == ord("'")) & start[:n] & (kind[1 : n + 1] == LETTER))
    if len(at):
        padded = np.zeros(n + 3, np.uint16)
        padded[:n] = codes
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.isin(one.astype(np.uint32) << 16 | two, [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")])
        hit = short | long
        at, after = at[hit], (at + np.where(short, 2, 3))[hit]
        start[at + 1] = False
        start[after] |= kind[after] == LETTER
    inside = kind != SPACE
    ends = np.flatnonzero(inside[:n] & (start[1 : n + 1] | ~inside[1 : n + 1])) + 1
    return np.flatnonzero(start[:n]), ends


class PieceCache:
    """Values of different pieces, found by the pieces' hashes."""

    def __init__(self) -> None:
        self.hashes, self.begins, self.lengths, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def full(self) -> bool:
        return len(self.hashes) > CACHE_PIECES or len(self.flat) > CACHE_IDS

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] != hashes

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        if self.full():
            self.__init__()
        begins = np.cumsum(lengths) - lengths + len(self.flat)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begins, self.lengths = np.insert(self.hashes, at, hashes), np.insert(self.begins, at, begins), np.insert(self.lengths, at, lengths)
        self.flat = np.concatenate([self.flat, ids])

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        return self.begins[at], self.lengths[at]


class Pieces:
    """Ids of texts from the ids of their pieces; how a piece gets its ids is a subclass's.

    ``specification`` is the tokenizer file's content.
    """

    def __init__(self, specification: dict) -> None:
        model = specification["model"]
        self.specials = [t["content"] for t in specification["added_tokens"]]
        self.special_ids = {t["content"]: t["id"] for t in specification["added_tokens"]}
        self.size = 1 + max(*model["vocab"].values(), *self.special_ids.values(), 0, 0)
        self.known = self._known(specification)
        self.cache = PieceCache()

    @staticmethod
    def _known(spec: dict) -> bool:
        first, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        level = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0].get("use_regex", True)
        return bool(level and kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern", {}).get("Regex") == PATTERN and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] and not any(t["normalized"] for t in spec["added_tokens"]))

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces, and how many each has."""
        raise NotImplementedError

    def _odd(self, text: str) -> np.ndarray:
        """Ids of a text that is not for numpy."""
        raise NotImplementedError

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
        if not (self.known and SAFE[codes].all() and not any(s in joined for s in self.specials)):
            if len(texts) > 1:
                parts = [self._group([t]) for t in texts]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            ids = self._odd(texts[0])
            return ids, np.array([len(ids)])
        codes = LOWER[codes]
        starts, ends = split(codes)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        hashes = hash_spans(codes, starts, ends)
        different, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = self.cache.missing(different)
        if new.any():
            if self.cache.full():
                self.cache, new = PieceCache(), np.ones(len(different), bool)
            low = codes.tobytes().decode("utf-16-le")
            self.cache.add(different[new], *self._new([low[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]))
        begins, lengths = self.cache.get(different)
        lengths = lengths[inverse]
        ids = self.cache.flat[ragged(begins[inverse], lengths)]
        total = np.r_[0, np.cumsum(lengths)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = total[np.searchsorted(starts, np.r_[0, np.cumsum(sizes + 1)])]
        return ids, np.diff(at)

    def _parts(self, text: str) -> list[str]:
        """A long text cut at white space, where no piece, nor anything the normalizer joins, goes on."""
        if len(text) <= GROUP_CHARACTERS or not self.known or any(s in text for s in self.specials):
            return [text]
        out, at = [], 0
        while len(text) - at > GROUP_CHARACTERS and (m := _BREAK.search(text, at + GROUP_CHARACTERS)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one uint32 array, and where each text's begin (one more)."""
        parts = [self._parts(t) for t in texts]
        flat = [x for p in parts for x in p]
        ids, counts = [np.empty(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in groups(flat, GROUP_CHARACTERS):
            x, n = self._group(flat[a:b])
            ids.append(x)
            counts.append(n)
        ends = np.r_[0, np.cumsum(np.concatenate(counts))]
        return np.concatenate(ids), ends[np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]]


def read_specification(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class WordTokens(Pieces):
    """``encode`` gives the ids of the library, without special tokens added."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = read_specification(path)
        super().__init__(spec)
        self.path, self._whole = path, None
        if self.known:
            spec |= {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}}
            self.pieces = Tokenizer.from_str(json.dumps(spec))
            suffix = spec["model"]["end_of_word_suffix"]
            self.final = np.zeros(self.size, bool)
            for token, i in spec["model"]["vocab"].items():
                self.final[i] = token.endswith(suffix)

    @property
    def whole(self):
        """The library's own tokenizer, loaded when a text first needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.no_truncation()
            self._whole.no_padding()
        return self._whole

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        step = 512
        found = self.pieces.encode_batch_fast([" ".join(pieces[i : i + step]) for i in range(0, len(pieces), step)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        lengths = np.diff(np.flatnonzero(self.final[ids]), prepend=-1)
        assert len(lengths) == len(pieces), "a piece without an end"
        return ids, lengths

    def _odd(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def load(path: str) -> WordTokens:
    """One a Python worker; a file is read once."""
    return tool(("word_tokens", path), lambda: WordTokens(path))


def with_end(ids: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` after each text's ids."""
    n = np.diff(begins) + 1
    at = np.r_[0, np.cumsum(n)]
    out = np.full(at[-1], end, np.uint32)
    if len(ids):
        keep = np.ones(at[-1], bool)
        keep[at[1:] - 1] = False
        out[keep] = ids
    return out, at
