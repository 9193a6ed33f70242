"""The compiled merge automaton against merge-by-merge encoding, on vocabularies of its own."""

import json
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from lattisphere.llm.bpe_automaton import MergeAutomaton, codec, decode, encode, encode_documents  # noqa: E402


def merged(word, merges, suffix):
    """Byte-pair encoding by its definition: the earliest merge that applies, everywhere from the left, again and again."""
    parts = [*word[:-1], word[-1] + suffix]
    order = {m: i for i, m in enumerate(merges)}
    while pairs := [order[p] for p in zip(parts, parts[1:]) if p in order]:
        a, b = merges[min(pairs)]
        out, i = [], 0
        while i < len(parts):
            both = parts[i : i + 2] == [a, b]
            out.append(a + b if both else parts[i])
            i += 2 if both else 1
        parts = out
    return parts


@st.composite
def vocabularies(draw):
    suffix = draw(st.sampled_from(["", "</w>"]))
    tokens = [*"abc", *(c + suffix for c in "abc" if suffix)]
    merges = []
    for _ in range(draw(st.integers(0, 12))):
        a = draw(st.sampled_from([t for t in tokens if not suffix or not t.endswith(suffix)]))
        b = draw(st.sampled_from(tokens))
        if a + b not in tokens:
            tokens.append(a + b)
            merges.append((a, b))
    return tokens, merges, suffix


def automaton(tmp_path_factory, tokens, merges, suffix):
    path = tmp_path_factory.mktemp("vocab") / "v.json"
    model = {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges], "end_of_word_suffix": suffix or None}
    path.write_text(json.dumps({"model": model, "added_tokens": []}))
    return MergeAutomaton(str(path))


@settings(max_examples=150, deadline=None)
@given(vocabularies())
def test_table_accepts_encodings_and_nothing_else(tmp_path_factory, case):
    tokens, merges, suffix = case
    made = automaton(tmp_path_factory, tokens, merges, suffix)
    words = ["".join(w) for n in range(1, 6) for w in product("abc", repeat=n)]
    right = {w: [tokens.index(t) for t in merged(w, merges, suffix)] for w in words}
    assert made.encode_words([w.encode() for w in words]) == [tuple(right[w]) for w in words]
    assert all(list(made._long(w.encode())) == ids for w, ids in right.items())
    ends = [t for t in tokens if t.endswith(suffix)]
    for n in range(1, 4):  # every sequence of up to three tokens: read to its end only if it is an encoding
        for path in product([t for t in tokens if not suffix or not t.endswith(suffix)], repeat=n - 1):
            for last in ends:
                state = 0
                for t in (*path, last):
                    state = made.step(state, tokens.index(t)) if state >= 0 else -1
                word = "".join((*path, last)).removesuffix(suffix)
                if len(word) <= 5:
                    assert (state >= 0) == (right[word] == [tokens.index(t) for t in (*path, last)])


def test_compiled_size():
    made = codec(P.path("word_bpe_49k.json")).automaton
    assert made.table.nbytes < 25_000_000 and len(made.state) == len(made.arc) == len(made.labels)


def test_two_merges_of_one_token(tmp_path_factory):
    with pytest.raises(ValueError):
        automaton(tmp_path_factory, ["a", "aa", "aaa"], [("a", "a"), ("aa", "a"), ("a", "aa")], "")


def test_columns_and_long_words(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    reader = Tokenizer.from_file(path)
    texts = [None, "", "x" * 3000, "a,b.c don't 42", "Ünïcode – “quoted” 中文 <|endoftext|>", "z" * 47 + " " + "y" * 49, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = encode_documents(docs, path)
    found = rows.select("doc_id", "ids", decode(rows.ids, path).alias("text")).collect()
    want = [reader.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted((r.ids, r.text) for r in found) == sorted((w, reader.decode(w, skip_special_tokens=False)) for w in want)
    assert docs.limit(0).select(encode(docs.text, path)).count() == 0
