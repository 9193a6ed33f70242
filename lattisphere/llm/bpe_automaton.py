"""BPE encoding and decoding by a deterministic automaton over tokens, compiled merge by merge.

The automaton starts with one state whose arcs are the single symbols, all leading back to it. Each merge (a, b) -> c adds
a gadget: the state that `a` leads to is cloned without its arc `b`, the arcs of `a` are led to the clone, and every state
that has an arc `a` gets an arc `c` to where `b` led. After the last merge the automaton reads exactly the sequences that
byte-pair encoding produces.

Where an arc leads depends on its token alone, so the compiled form is `state` (token -> state), `arc` (token -> class of
arcs) and `table`, one bit for each state and class of arcs. States and classes are shared by tokens as long as no gadget
tells them apart, and cloned when one does; the 49 thousand tokens of the CLIP-like vocabulary have some 11,500 states and
13,700 classes, 20 MB of bits.

Words are encoded from left to right, many at once: from the state at every place that an encoding reaches, the bytes are
followed through a trie of the vocabulary, and a token whose arc the state has is the last one of the prefix it ends.
The path to each place is the only one, so following it back gives the word's tokens. Decoding emits the label of every arc.

Defined results: null text encodes as empty text; empty text has no tokens and decodes to "". Special strings in a text
are one token each, as the tokenizers library has them by default. Words of any length are encoded whole. Repeated rows give
equal results; other columns are not read.
"""

from __future__ import annotations

import gc
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of these characters only are split by the fast path: lower-casing them letter by letter and NFC are plain there.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ–—‘-„…€]*").fullmatch
#: Characters of texts that are encoded together, and entries of the caches of words beyond which they start anew.
TOGETHER, CACHED = 4_000_000, 250_000
#: Words up to these lengths, in bytes, are encoded in one block each; longer ones one by one.
_BLOCKS = (8, 16, 48)


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stays, the rest moves above 255."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class MergeTable:
    """The automaton while it is compiled: bits of arcs, states as rows and classes of arcs as columns."""

    def __init__(self, tokens: int):
        self.bits = np.zeros((1024, 128), np.uint8)
        self.bits[0, 0] = 1  # the first state has an arc for every symbol
        self.state, self.arc = np.zeros(tokens, np.int32), np.zeros(tokens, np.int32)
        self.n_states, self.n_arcs = 1, 1
        self.held_states, self.held_arcs = [tokens], [tokens]  # how many tokens share each; merged ones join when they are made

    def has(self, state: int, arc: int) -> bool:
        return bool(self.bits[state, arc >> 3] >> (arc & 7) & 1)

    def _own_state(self, token: int) -> int:
        old = int(self.state[token])
        if self.held_states[old] == 1:
            return old
        if self.n_states == len(self.bits):
            self.bits = np.vstack([self.bits, np.zeros_like(self.bits)])
        new, self.n_states = self.n_states, self.n_states + 1
        self.bits[new] = self.bits[old]
        self.held_states[old] -= 1
        self.held_states.append(1)
        self.state[token] = new
        return new

    def _own_arc(self, token: int) -> int:
        old = int(self.arc[token])
        if self.held_arcs[old] == 1:
            return old
        if self.n_arcs == 8 * self.bits.shape[1]:
            self.bits = np.hstack([self.bits, np.zeros_like(self.bits)])
        new, self.n_arcs = self.n_arcs, self.n_arcs + 1
        n = self.n_states
        self.bits[:n, new >> 3] |= (self.bits[:n, old >> 3] >> np.uint8(old & 7) & np.uint8(1)) << np.uint8(new & 7)
        self.held_arcs[old] -= 1
        self.held_arcs.append(1)
        self.arc[token] = new
        return new

    def gadget(self, a: int, b: int, c: int) -> None:
        """Merge (a, b) -> c; c has been no token before."""
        if not self.has(self.state[a], self.arc[b]):  # never side by side at this time: no sequence holds c
            self.bits[: self.n_states, self._own_arc(c) >> 3] &= np.uint8(~(1 << (self.arc[c] & 7)) & 255)
            return
        self.held_states[self.state[c]] -= 1
        self.state[c] = self.state[b]  # c leads to where b led; first, as a and b may be the same
        self.held_states[self.state[c]] += 1
        state, arc = self._own_state(a), self._own_arc(b)
        self.bits[state, arc >> 3] &= np.uint8(~(1 << (arc & 7)) & 255)
        self.held_arcs[self.arc[c]] -= 1
        self.arc[c] = self.arc[a]  # the states that have an arc a
        self.held_arcs[self.arc[c]] += 1


class MergeAutomaton:
    """The compiled automaton of one vocabulary file (BPE model, with or without an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.labels[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._compile([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self._spell(vocab)

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        made = MergeTable(len(self.labels))
        seen = set()
        for a, b, c in merges:
            if c in seen:
                raise ValueError(f"two merges make the token {self.labels[c]!r}")
            seen.add(c)
            made.gadget(a, b, c)
        self.state, self.arc = made.state, made.arc
        self.table = np.ascontiguousarray(made.bits[: made.n_states, : -(-made.n_arcs // 8)])

    def step(self, state: int, token: int) -> int:
        """The state that the arc of a token leads to, -1 where the state has no such arc."""
        arc = int(self.arc[token])
        return int(self.state[token]) if self.table[state, arc >> 3] >> (arc & 7) & 1 else -1

    def _spell(self, vocab: dict[str, int]) -> None:
        """The trie of the vocabulary over bytes, as sorted keys node * 256 + byte, and the token at each node."""
        bytes_of = {c: b for b, c in enumerate(_byte_letters())}
        children: dict[int, int] = {}
        inner, final = [-1], [-1]
        for token, i in vocab.items():
            end = bool(self.suffix) and token.endswith(self.suffix)
            letters = token[: -len(self.suffix)] if end else token
            if not letters or any(c not in bytes_of for c in letters):
                continue
            node = 0
            for c in letters:
                key = node << 8 | bytes_of[c]
                node = children.setdefault(key, len(inner))
                if node == len(inner):
                    inner.append(-1)
                    final.append(-1)
            if end or not self.suffix:
                final[node] = i
            if not end:
                inner[node] = i
        keys = np.array(sorted(children), np.int64)
        self._keys, self._children = keys, np.array([children[int(k)] for k in keys], np.int32)
        self._first = np.full(256, -1, np.int32)  # the root's children, and those of its children, are looked up directly
        self._second = np.full(1 << 16, -1, np.int32)
        for key, child in children.items():
            if key < 256:
                self._first[key] = child
        at = {int(n): b for b, n in enumerate(self._first) if n >= 0}
        for key, child in children.items():
            if key >> 8 in at:
                self._second[at[key >> 8] << 8 | key & 255] = child
        self._inner, self._final = np.array(inner, np.int32), np.array(final, np.int32)

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._children[at], -1)

    def _block(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        """The tokens of words of at most `width` bytes each."""
        m = len(words)
        length = np.fromiter(map(len, words), np.int64, m)
        text = np.zeros((width + 1, m), np.int64)  # by place, then by word
        flat = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(m), length)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length), word] = flat
        last, start = np.full((width + 1, m), -1, np.int32), np.zeros((width + 1, m), np.int16)
        everyone = np.arange(m)
        for i in range(width):
            who = everyone[length > i] if i == 0 else np.flatnonzero((length > i) & (last[i] >= 0))
            if not len(who):
                continue
            state = self.state[last[i, who]] if i else np.zeros(len(who), np.int32)
            for j in range(i, width):
                if j == i:
                    node = self._first[text[i, who]]
                elif j == i + 1:
                    node = self._second[text[i, who] << 8 | text[j, who]]
                else:
                    node = self._child(node, text[j, who])
                on = node >= 0
                if not on.all():
                    who, node, state = who[on], node[on], state[on]
                    if not len(who):
                        break
                token = np.where(length[who] == j + 1, self._final[node], self._inner[node])
                arc = self.arc[token]
                good = (token >= 0) & ((self.table[state, arc >> 3] >> (arc & 7).astype(np.uint8) & 1) > 0)
                last[j + 1, who[good]] = token[good]
                start[j + 1, who[good]] = i
                on = length[who] > j + 1
                if not on.all():
                    who, node, state = who[on], node[on], state[on]
                    if not len(who):
                        break
        found, at, who = [], length.copy(), everyone
        while len(who):
            found.append((who, last[at[who], who]))
            at[who] = start[at[who], who]
            who = who[at[who] > 0]
        order = np.concatenate([w for w, _ in found[::-1]])
        tokens = np.concatenate([t for _, t in found[::-1]])[np.argsort(order, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(order, minlength=m)).tolist()
        return [tuple(tokens[a:b]) for a, b in zip([0, *ends], ends)]

    def _long(self, word: bytes) -> tuple[int, ...]:
        """One word of any length; the same transitions, place by place."""
        n, keys, children = len(word), self._keys, self._children
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            if i and last[i] < 0:
                continue
            state, node = int(self.state[last[i]]) if i else 0, 0
            for j in range(i, n):
                key = node << 8 | word[j]
                at = int(np.searchsorted(keys, key)) if j > i else -1
                node = int(self._first[word[j]]) if at < 0 else int(children[at]) if at < len(keys) and keys[at] == key else -1
                if node < 0:
                    break
                token = int((self._final if j + 1 == n else self._inner)[node])
                if token >= 0 and self.step(state, token) >= 0:
                    last[j + 1], start[j + 1] = token, i
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at = start[at]
        return tuple(out[::-1])

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each of the pre-split words, given in bytes."""
        out: list[tuple[int, ...]] = [()] * len(words)
        below = 0
        for width in _BLOCKS:
            own = [i for i, w in enumerate(words) if below < len(w) <= width]
            if own:
                for i, ids in zip(own, self._block([words[i] for i in own], width)):
                    out[i] = ids
            below = width
        for i, w in enumerate(words):
            if len(w) > below:
                out[i] = self._long(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined as the library joins tokens where a file names no decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


class WordCodec:
    """Normalizes and pre-splits text as the file says, and encodes the words by the automaton."""

    _split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # fixed value of the file

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.automaton = MergeAutomaton(path)
        self.reader = Tokenizer.from_file(path)  # for the normalizer and the pre-tokenizer of uncommon characters
        self.specials = re.compile("(" + "|".join(map(re.escape, self.automaton.special)) + ")") if self.automaton.special else None
        self.bytes_of = {c: b for b, c in enumerate(_byte_letters())}
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def _parts(self, text: str) -> list[tuple[int | None, list]]:
        """Runs of the text: the id of a special string, or None and its pieces, chunks (str) or words (bytes)."""
        parts = self.specials.split(text) if self.specials and any(s in text for s in self.automaton.special) else [text]
        out: list[tuple[int | None, list]] = []
        for part in parts:
            special = self.automaton.special.get(part)
            if special is not None:
                out.append((special, []))
            elif _PLAIN(part):
                out.append((None, part.lower().split()))
            else:
                pieces = self.reader.pre_tokenizer.pre_tokenize_str(self.reader.normalizer.normalize_str(part))
                out.append((None, [bytes(map(self.bytes_of.__getitem__, p)) for p, _ in pieces]))
        return out

    def _learn(self, chunks: set[str], words: set[bytes]) -> None:
        """Encode what the caches don't hold yet: all words at once."""
        known, held = self.words, self.chunks
        new = [c for c in chunks if c not in held]
        plain = [c for c in new if c.isalpha()]  # one word each; the others are split by the file's pattern
        mixed = {c: [w.encode() for w in self._split.findall(c)] for c in new if not c.isalpha()}
        letters = list(map(str.encode, plain))
        words = words.union(letters, *mixed.values())
        words.difference_update(known)
        todo = list(words)
        known.update(zip(todo, self.automaton.encode_words(todo)))
        held.update(zip(plain, map(known.__getitem__, letters)))
        for chunk, own in mixed.items():
            held[chunk] = known[own[0]] if len(own) == 1 else tuple(chain.from_iterable(map(known.__getitem__, own)))

    def _together(self, texts: list[str]) -> list[list[int]]:
        parts = [self._parts(t) if t else [] for t in texts]
        for cache in (self.words, self.chunks):
            if len(cache) > CACHED:
                cache.clear()
        chunks: set[str] = set()
        words: set[bytes] = set()
        for own in parts:
            for _, pieces in own:
                if pieces:
                    (chunks if isinstance(pieces[0], str) else words).update(pieces)
        self._learn(chunks, words)
        of_chunk, of_word = self.chunks.__getitem__, self.words.__getitem__
        out = []
        for own in parts:
            ids: list[int] = []
            for special, pieces in own:
                if special is not None:
                    ids.append(special)
                elif pieces:
                    ids.extend(chain.from_iterable(map(of_chunk if isinstance(pieces[0], str) else of_word, pieces)))
            out.append(ids)
        return out

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        out: list[list[int]] = []
        at, collects = 0, gc.isenabled()
        gc.disable()  # the many small tuples made here hold no cycles, and looking for some takes a third of the time
        try:
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= TOGETHER):
                    size += len(texts[end] or "")
                    end += 1
                out += self._together([t or "" for t in texts[at:end]])
                at = end
        finally:
            if collects:
                gc.enable()
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids)


@lru_cache(2)
def codec(path: str) -> WordCodec:
    """One codec for each Python worker and file."""
    return WordCodec(path)


def encode(text: Column, path: str) -> Column:
    """array<int> of token ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array(own.encode_many(texts.to_pylist()), pa.list_(pa.int32()))

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of token ids; null gives null."""

    @F.arrow_udf(T.StringType())
    def run(rows: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([None if r is None else own.decode(r) for r in rows.to_pylist()], pa.string())

    return run(ids)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for each row; other columns are not read."""
    return docs.select(F.col(key), encode(F.col(text), path).alias("ids"))
