"""Token ids and counts of byte-level BPE for texts of any length: overlapping chunks, resynchronised.

A text of up to `window` code points is encoded at once. A longer one is encoded in chunks that overlap; the ids come
with byte offsets (each label has one letter for each byte), and two neighbouring chunks are spliced at a boundary
inside their overlap that both encodings have and that is proven stable: between a character that is no white space
and white space. No pre-token reaches over such a place and none looks back over it, so all ids before it depend only
on the text before it and all ids after it only on the text after it. Where an overlap holds no such place, or the two
encodings disagree, the right chunk starts earlier and the left chunk ends later, twice as far each time, up to the whole
text. Results equal those of one pass over the whole text.

Defined results: null counts as empty text, which has 0 tokens. A special string inside a text is one token, as the
tokenizers library has it by default. Repeated rows give equal results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, OVERLAP = 32_768, 512
#: Characters whose classes are the same in both libraries' tables.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ–—‘-„…€]*").fullmatch
_STABLE = re.compile(r"(?<=[!-~¡-ɏ])[ \n]")


class ByteTokens:
    """The vocabulary of a byte-level file of the tokenizers library.

    Common characters go through tiktoken over the same vocabulary and pattern, which gives the same ids faster; any
    other text goes through the file's own library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.reader = Tokenizer.from_file(path)
        vocab = self.reader.get_vocab(with_added_tokens=False)
        self.special = {t.content: i for i, t in self.reader.get_added_tokens_decoder().items()}
        self.lengths = np.ones(max([*vocab.values(), *self.special.values()]) + 1, np.int64)
        letters = {c: b for b, c in enumerate(_letters())}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        for raw, i in ranks.items():
            self.lengths[i] = len(raw)
        for token, i in self.special.items():
            self.lengths[i] = len(token.encode())
        import public_tokenizers

        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str) -> list[int]:
        """Ids of a text in one pass."""
        if not _PLAIN(text):
            return self.reader.encode(text, add_special_tokens=False).ids
        if not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        out: list[int] = []
        for part in self.parts.split(text):
            out += [self.special[part]] if part in self.special else self.fast.encode_ordinary(part)
        return out

    def spliced(self, text: str | None, window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[list[int]]:
        """Ids of a text, in order, in pieces of about a window."""
        text = text or ""
        start, skip = 0, 0  # the chunk's first code point; how many of its leading ids the chunk before has covered
        end = min(len(text), window)
        ids = self.encode(text[start:end])
        while end < len(text):
            wide = overlap
            while True:
                seam = self._seam(text, start, end, ids, skip, wide)
                if seam or end == len(text):
                    break
                wide *= 2
                end = min(len(text), end + wide)
                ids = self.encode(text[start:end])
            if not seam:
                break
            yield ids[skip : seam[0]]
            start, skip, end, ids = seam[1:]
            end_wanted = min(len(text), start + window)
            if end < end_wanted:
                end, ids = end_wanted, self.encode(text[start:end_wanted])
        yield ids[skip:]

    def _seam(self, text: str, start: int, end: int, ids: list[int], skip: int, wide: int):
        """(ids of the left chunk to keep, start of the right chunk, ids of it to skip, its end, its ids), or None."""
        low = max(start + 1, end - wide)
        ends = np.cumsum(self.lengths[ids])
        right_end = min(len(text), low + WINDOW)
        right = None
        for m in _STABLE.finditer(text, low, max(low, end - 1)):
            place = m.start()
            at = len(text[start:place].encode())
            k = int(np.searchsorted(ends, at))
            if k >= len(ends) or ends[k] != at or k + 1 < skip:
                continue
            if right is None:
                right = self.encode(text[low:right_end])
                right_ends = np.cumsum(self.lengths[right])
            at = len(text[low:place].encode())
            j = int(np.searchsorted(right_ends, at))
            if at == 0:
                return k + 1, low, 0, right_end, right
            if j < len(right_ends) and right_ends[j] == at:
                return k + 1, low, j + 1, right_end, right
        return None

    def ids(self, text: str | None) -> list[int]:
        return [i for part in self.spliced(text) for i in part]

    def count(self, text: str | None) -> int:
        return sum(map(len, self.spliced(text)))


def _letters() -> list[str]:
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


@lru_cache(2)
def vocabulary(path: str) -> ByteTokens:
    """One vocabulary for each Python worker and file."""
    return ByteTokens(path)


def token_ids(text: Column, path: str) -> Column:
    """array<int> of token ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        own = vocabulary(path)
        return pa.array([own.ids(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return run(text)


def token_count(text: Column, path: str) -> Column:
    """long: the number of token ids."""

    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        own = vocabulary(path)
        return pa.array([own.count(t) for t in texts.to_pylist()], pa.int64())

    return run(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(key), F.octet_length(whole).cast("long").alias("n_bytes"), token_count(whole, path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
