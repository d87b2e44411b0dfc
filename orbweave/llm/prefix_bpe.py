"""BPE by dynamic programming over prefixes, and decoding.

A piece of text has one encoding, and so has each of its prefixes; the encoding
of a prefix ends in one token, and what is before that token is the encoding of
a shorter prefix.  So it is enough to store the last token of every prefix and
to follow these back from the end.  A token that ends the prefix is the last
one exactly if it is compatible with the last token of what is before it: if
the two, put together, would be encoded as these two again.

The tokens that end a prefix come from a suffix automaton of the vocabulary,
which keeps the longest stretch before each place that lies in some token;
from the longest token in it, links lead to the next shorter ones.  The
compatibility test undoes both tokens' merges along their seam, latest first,
and asks whether an earlier merge would have joined across it.

All different pieces of a batch are worked on in step, a symbol at a time, with
numpy; the few longest go on alone, so that a piece's cost does not grow beyond
some microseconds a byte.  A symbol is a byte, or a byte that ends its piece.  Splitting a text
into pieces is shared with `word_tokens`; texts that are not plain there are
normalised and split with the tokenizers library, and encoded here all the same.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbweave.llm.common import binary_array, ddl, id_and_text, in_batches
from orbweave.llm.text_kernels import ragged
from orbweave.llm.word_tokens import Pieces, read_specification

END = 256  # symbols at or above end their piece
_NONE = -1
#: So many pieces or fewer are worked on one by one, not in step.
FEW = 32
#: Pairs, and transitions, whose answers a worker keeps.
PAIRS_KNOWN = 1 << 19


class PairTable:
    """A map from pairs of small integers to integers, looked up with numpy."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: np.ndarray, width: int) -> None:
        self.width = width
        key = a.astype(np.int64) * width + b
        self.bits = max(4, int(np.ceil(np.log2(max(2, 2 * len(key))))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):  # everyone who finds the place free takes it; one wins, the rest move on
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = key[free]
            won = self.keys[at[left]] == key[left]
            self.values[at[left[won]]] = value[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Values, -1 for pairs that are not there."""
        key = a.astype(np.int64) * self.width + b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], _NONE)
        left = np.flatnonzero((found != key) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


def suffix_automaton(words: list[tuple[int, ...]]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Transitions, suffix links and greatest lengths of all words' factors."""
    to: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    for word in words:
        last = 0
        for c in word:
            if c in to[last]:
                q = to[last][c]
                if size[q] == size[last] + 1:
                    last = q
                    continue
                p, current = last, None
            else:
                current = len(to)
                to.append({})
                size.append(size[last] + 1)
                link.append(0)
                p = last
                while p != -1 and c not in to[p]:
                    to[p][c] = current
                    p = link[p]
                if p == -1:
                    last = current
                    continue
                q = to[p][c]
            if size[q] == size[p] + 1:
                target = q
            else:
                target = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = target
                while p != -1 and to[p].get(c) == q:
                    to[p][c] = target
                    p = link[p]
            if current is None:
                last = target
            else:
                link[current] = target
                last = current
    return to, link, size


@cache
def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PrefixBPE(Pieces):
    """Pieces are encoded by the prefixes' last tokens.

    Made on the driver and broadcast: tables of numbers, bounded by the vocabulary.
    """

    def __init__(self, path: str) -> None:
        spec = read_specification(path)
        super().__init__(spec)
        if not self.known:
            raise ValueError("this file's normalizer, splitting or model is not the one known here")
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        self.bytes_of = {c: b for b, c in byte_characters().items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # ranks: single symbols first, then tokens in the order of their merges
        names = [c for c, _ in sorted(((t, i) for t, i in vocabulary.items() if len(t.removesuffix(suffix) or t) == 1), key=lambda x: x[1])]
        rank = {name: r for r, name in enumerate(names)}
        self.base = len(names)
        left, right = list(range(self.base)), list(range(self.base))
        for a, b in merges:
            if a + b not in rank:
                rank[a + b] = len(left)
                names.append(a + b)
                left.append(rank[a])
                right.append(rank[b])
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        n = len(names)
        self.id_of = np.array([vocabulary[x] for x in names], np.uint32)
        merged = np.arange(self.base, n)
        self.merge = PairTable(self.left[merged], self.right[merged], merged, n)
        words = [self._symbols(x, suffix) for x in names]
        self.length = np.array([len(w) for w in words], np.int32)
        to, link, size = suffix_automaton(words)
        self.link, self.reach = np.array(link, np.int32), np.array(size, np.int32)
        edges = np.array([(s, c, t) for s, out in enumerate(to) for c, t in out.items()], np.int64)
        self.next = PairTable(edges[:, 0], edges[:, 1], edges[:, 2], 2 * END)
        self._link_tokens(words, to)
        # the library's normalizer and splitting, for texts that numpy does not split
        light = spec | {"added_tokens": [], "post_processor": None, "truncation": None, "padding": None, "model": model | {"vocab": {}, "merges": [], "unk_token": None}}
        self.light = json.dumps(light)

    def _symbols(self, token: str, suffix: str) -> tuple[int, ...]:
        body, final = (token[: -len(suffix)], True) if len(token) > len(suffix) and token.endswith(suffix) else (token, False)
        out = [self.bytes_of[c] for c in body]
        if final:
            out[-1] += END
        return tuple(out)

    def _link_tokens(self, words: list[tuple[int, ...]], to: list[dict[int, int]]) -> None:
        """The longest token in each state's strings, and each token's next shorter one."""
        inside: dict[int, list[int]] = {}
        for token, word in enumerate(words):
            state = 0
            for c in word:
                state = to[state][c]
            inside.setdefault(state, []).append(token)
        self.longest = np.full(len(to), _NONE, np.int32)
        self.shorter = np.full(len(words), _NONE, np.int32)
        for state in np.argsort(self.reach, kind="stable").tolist():
            known = int(self.longest[self.link[state]]) if state else _NONE
            for token in sorted(inside.get(state, ()), key=lambda t: len(words[t])):
                self.shorter[token] = known
                known = token
            self.longest[state] = known

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens, by rank, stay two when put together."""
        out = np.ones(len(a), bool)
        a, b, at = a.copy(), b.copy(), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int32).max, np.int32)
        while len(at):
            joined = self.merge.get(a, b)
            bad = (joined != _NONE) & (joined < limit)
            out[at[bad]] = False
            # take apart the one merged later; a single symbol cannot be, then the other one
            single_a, single_b = a < self.base, b < self.base
            go = ~bad & ~(single_a & single_b)
            a, b, at, single_b = a[go], b[go], at[go], single_b[go]
            first = (a > b) & (a >= self.base) | single_b
            limit = np.where(first, a, b + 1).astype(np.int32)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def encode_pieces(self, symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all pieces' tokens, and how many each piece has."""
        sizes = np.diff(begins).astype(np.int64)
        last = np.full(len(symbols), _NONE, np.int32)
        order = np.argsort(-sizes, kind="stable")
        begin, remaining = begins[:-1][order], sizes[order]
        state, matched = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for place in range(int(remaining[0]) if len(order) else 0):
            live = int(np.searchsorted(-remaining, -place, side="left"))
            if live <= FEW:  # the longest pieces go on one by one
                for k in range(live):
                    a, n = int(begin[k]), int(remaining[k])
                    last[a + place : a + n] = self._further(symbols[a + place : a + n].tolist(), last[a : a + place].tolist(), int(state[k]), int(matched[k]))
                break
            begin, state, matched = begin[:live], state[:live], matched[:live]
            c = symbols[begin + place]
            to = self.next.get(state, c)
            lost = np.flatnonzero(to == _NONE)
            now, length = state.copy(), matched.copy()
            while len(lost):
                now[lost] = self.link[now[lost]]
                length[lost] = self.reach[now[lost]]
                to[lost] = self.next.get(now[lost], c[lost])
                lost = lost[to[lost] == _NONE]
            state, matched = to.astype(np.int64), length + 1
            token = self.longest[state]
            left = np.arange(live)
            while len(left):
                t = token[left]
                n = self.length[t].astype(np.int64)
                fits = n <= matched[left]
                start = place + 1 - n
                ok = fits & (start == 0)
                test = np.flatnonzero(fits & (start > 0))
                ok[test] = self.compatible(last[begin[left[test]] + start[test] - 1], t[test])
                last[begin[left[ok]] + place] = t[ok]
                left = left[~ok]
                token[left] = self.shorter[token[left]]
        return self._back(last, begins, sizes)

    def _lists(self) -> tuple:
        """The tables as lists, with what is known of pairs and transitions so far; one a process."""
        if not hasattr(self, "_plain"):
            merge = dict(zip(zip(self.left[self.base :].tolist(), self.right[self.base :].tolist(), strict=True), range(self.base, len(self.left)), strict=True))
            self._plain = (*(x.tolist() for x in (self.left, self.right, self.link, self.reach, self.longest, self.shorter, self.length)), merge, {}, {})
        return self._plain

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_plain"}

    def _further(self, symbols: list[int], known: list[int], state: int, matched: int) -> list[int]:
        """The last tokens of a piece's further prefixes, from those ``known`` and the automaton's state on."""
        left, right, link, reach, longest, shorter, lengths, merge, pairs, edges = self._lists()
        base, place = self.base, len(known)
        begin = place

        def stay_two(a: int, b: int) -> bool:
            limit = 1 << 31
            while True:
                joined = merge.get((a, b))
                if joined is not None and joined < limit:
                    return False
                if a < base and b < base:
                    return True
                if b < base or a >= base and a > b:
                    limit, a = a, right[a]
                else:
                    limit, b = b + 1, left[b]

        for c in symbols:
            while True:
                key = state * 2 * END + c
                to = edges.get(key)
                if to is None:
                    if len(edges) >= PAIRS_KNOWN:
                        edges.clear()
                    to = edges[key] = int(self.next.get(np.array([state]), np.array([c]))[0])
                if to != _NONE:
                    break
                state = link[state]
                matched = reach[state]
            state, matched = to, matched + 1
            t = longest[state]
            while True:
                n = lengths[t]
                if n <= matched:
                    if n == place + 1:
                        break
                    pair = known[place - n], t
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= PAIRS_KNOWN:
                            pairs.clear()
                        fits = pairs[pair] = stay_two(*pair)
                    if fits:
                        break
                t = shorter[t]
            known.append(t)
            place += 1
        return known[begin:]

    def _back(self, last: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the last tokens back from every piece's end."""
        chosen = np.zeros(len(last), bool)
        at, begin = begins[1:][sizes > 0] - 1, begins[:-1][sizes > 0]
        while len(at):
            if len(at) <= FEW:
                lengths = self._lists()[6]
                for i, first in zip(at.tolist(), begin.tolist(), strict=True):
                    tokens = last[first : i + 1].tolist()
                    while i >= first:
                        chosen[i] = True
                        i -= lengths[tokens[i - first]]
                break
            chosen[at] = True
            at = at - self.length[last[at]]
            go = at >= begin
            at, begin = at[go], begin[go]
        total = np.r_[0, np.cumsum(chosen)]
        return last[chosen], total[begins[1:]] - total[begins[:-1]]

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [p.encode() for p in pieces]
        begins = np.r_[0, np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))]
        symbols = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        symbols[begins[1:] - 1] += END
        ranks, counts = self.encode_pieces(symbols, begins)
        return self.id_of[ranks], counts

    def _odd(self, text: str) -> np.ndarray:
        """A text with special tokens or with characters that need the library's tables."""
        import regex

        library = _library(self.light)
        ids: list[np.ndarray] = [np.empty(0, np.uint32)]
        for part in regex.split("(" + "|".join(map(regex.escape, self.specials)) + ")", text) if self.specials else [text]:
            if part in self.special_ids:
                ids.append(np.array([self.special_ids[part]], np.uint32))
            elif part:
                found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))
                pieces = [bytes(self.bytes_of[c] for c in p) for p, _ in found]
                different = sorted(set(pieces))
                if different:
                    begins = np.r_[0, np.cumsum([len(p) for p in different])]
                    symbols = np.frombuffer(b"".join(different), np.uint8).astype(np.int64)
                    symbols[begins[1:] - 1] += END
                    ranks, counts = self.encode_pieces(symbols, begins)
                    at = np.searchsorted(np.array(different, object), np.array(pieces, object))
                    ids.append(self.id_of[ranks[ragged((np.cumsum(counts) - counts)[at], counts[at])]])
        return np.concatenate(ids)


class Names:
    """``decode`` gives texts as the library decodes ids, special tokens included."""

    def __init__(self, path: str) -> None:
        spec = read_specification(path)
        vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max(vocabulary.values(), default=0))
        for name, i in vocabulary.items():
            self.names[i] = name
        self.light = json.dumps(spec | {"added_tokens": [], "post_processor": None, "truncation": None, "padding": None, "model": spec["model"] | {"vocab": {}, "merges": [], "unk_token": None}}) if spec["decoder"] else None

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> list[str]:
        name, at = self.names.__getitem__, list(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True))
        if self.light:
            decoder = _library(self.light).decoder
            return [decoder.decode(list(map(name, ids[a:b].tolist()))) for a, b in at]
        return [" ".join(map(name, ids[a:b].tolist())) for a, b in at]


@cache
def _library(specification: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(specification)


@cache
def load(path: str) -> PrefixBPE:
    """One a process; the automaton is built once, on the driver."""
    return PrefixBPE(path)


@cache
def load_names(path: str) -> Names:
    return Names(path)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _encoded(tables: PrefixBPE, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return tables.encode([t or "" for t in texts.to_pylist()])


def _bytes(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return binary_array(flat.astype("<u4").tobytes(), 4 * at)


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit.

    A null text counts as empty and has no ids.  Rows with equal or null ids are
    answered each; other columns are ignored; an empty table stays empty.
    """
    tables = docs.sparkSession.sparkContext.broadcast(load(tokenizer))

    def run(ids: pa.Array, texts: pa.Array) -> list:
        flat, at = _encoded(tables.value, texts)
        return [ids, np.diff(at), _bytes(flat, at)]

    return id_and_text(docs, id_column, text_column).mapInArrow(in_batches(["doc_id", "text"], ENCODED, run), ddl(ENCODED))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of `encode` with the text that the library decodes.

    No ids, an empty text.  Needs the tokens' names only.
    """
    names = encoded.sparkSession.sparkContext.broadcast(load_names(tokenizer))

    def run(ids: pa.Array, counts: pa.Array, data: pa.Array) -> list:
        n = counts.to_numpy()
        return [ids, counts, data, names.value.decode(np.frombuffer(b"".join(data.to_pylist()), "<u4"), np.r_[0, np.cumsum(n)])]

    return encoded.mapInArrow(in_batches(["doc_id", "n_tokens", "ids"], DECODED, run), ddl(DECODED))


def round_trip(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `decode` of `encode`, in one pass: a task has one Python worker, not two."""
    context = docs.sparkSession.sparkContext
    tables, names = context.broadcast(load(tokenizer)), context.broadcast(load_names(tokenizer))

    def run(ids: pa.Array, texts: pa.Array) -> list:
        flat, at = _encoded(tables.value, texts)
        stored = _bytes(flat, at)
        return [ids, np.diff(at), stored, names.value.decode(np.frombuffer(b"".join(stored.to_pylist()), "<u4"), at)]

    return id_and_text(docs, id_column, text_column).mapInArrow(in_batches(["doc_id", "text"], DECODED, run), ddl(DECODED))
