"""Parts of the operators against their definitions, with generated inputs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from lattisphere.llm.bpe_automaton import WordCodec  # noqa: E402
from lattisphere.llm.byte_tokens import ByteTokens  # noqa: E402
from lattisphere.llm.html_text import GONE, KEPT, OPEN, extract_text, segments  # noqa: E402
from lattisphere.llm.ngram_join import EXTRA, alpha, one_of_each, prefix_length  # noqa: E402
from lattisphere.llm.packing import plan  # noqa: E402

LETTERS = "ab c  \n\t't's12.,!<|endoftext|>é中🙂\x85　 ΣßAZ"


@pytest.fixture(scope="module")
def readers():
    from tokenizers import Tokenizer

    word, byte = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
    return WordCodec(word), Tokenizer.from_file(word), ByteTokens(byte), Tokenizer.from_file(byte)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=200) | st.text(max_size=60))
def test_tokens_equal_the_library(readers, text):
    codec, word, byte, reader = readers
    text = text.encode("utf-8", "ignore").decode()
    ids = word.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids and codec.decode(ids) == word.decode(ids, skip_special_tokens=False)
    pieces = [i for part in byte.spliced(text, window=24, overlap=4) for i in part]
    assert pieces == reader.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([10, 30, 2048]).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 50), max_size=30))))
def test_plans_fill_without_gaps(case):
    capacity, lengths = case
    runs, n = plan(lengths, capacity)
    bins = {}
    for i, (length, start, first, each, offset) in enumerate(runs.tolist()):
        end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else lengths[length]
        for j in range(end - start):
            bins.setdefault(first + j // each, []).append((offset + j % each * length, length))
    assert len(bins) == n and sum(map(len, bins.values())) == sum(lengths.values())
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400), st.data())
def test_prefixes_lose_no_link(nx, ny, data):
    """Two sets that share alpha elements share as many prefix elements as is asked of them, wherever the shared ones are."""
    need = int(alpha(nx, ny))
    if need > min(nx, ny):
        return
    shared = data.draw(st.integers(need, min(nx, ny)))
    seed = data.draw(st.integers(0, 10_000))
    order = list(range(nx + ny - shared))
    random.Random(seed).shuffle(order)
    x, y = sorted(order[:nx]), sorted(order[nx - shared :])
    px, ex = prefix_length(np.array([float(seed % 7)] * nx))
    py, ey = prefix_length(np.array([float(seed % 3)] * ny))
    assert len(x) == nx and len(y) == ny and px <= nx and py <= ny and ex < len(EXTRA) and ey < len(EXTRA)
    assert len(set(x[:px]) & set(y[:py])) >= max(1, need - max(nx - px, ny - py))


def test_one_of_each_judges_rows_of_one_key(spark):
    words = lambda p: " ".join(f"{p}{k}" for k in range(30))
    rows = [("x", words("a"), 1), ("x", words("b"), 2), ("y", words("a"), 3), ("y", words("c"), 3), ("y", words("c"), 3), ("z", words("c"), 4), ("z", words("d"), 4), ("z", None, 5), ("z", "", 5), (None, words("a"), 6), ("w", words("d") + " end", 7)]
    docs = spark.createDataFrame([(k, n, t) for k, t, n in rows], "doc_id string, n int, text string")
    found = one_of_each(docs)
    assert found.columns == docs.columns
    want = [("x", words("a"), 1), ("x", words("b"), 2), ("y", words("c"), 3), ("z", None, 5), ("z", "", 5), (None, words("a"), 6), ("w", words("d") + " end", 7)]
    same = lambda rs: sorted((str(k), str(t), n) for k, t, n in rs)
    assert same((r.doc_id, r.text, r.n) for r in found.collect()) == same(want)


def test_segments():
    page = "<div id='sidebar'>menu</div><main><p>a&nbsp;b<script>x='</p>'</script><p>c<aside>no</aside></main><p>rest<!-- c --> of<br>it"
    assert segments(page) == [(GONE, "menu"), (KEPT, "a b"), (KEPT, "c"), (GONE, "no"), (OPEN, "rest of"), (OPEN, "it")]
    assert segments(None) == segments("") == []


def test_names_are_whole_attributes():
    kept = lambda page: " ".join(t for zone, t in segments(page) if zone == KEPT)
    assert kept('<article style="overflow:hidden"><p>all of it</p></article>') == "all of it"
    assert kept('<article>to <a href="/hidden-gems">gems</a> and <a href="/x?id=comments">on</a> <b data-id="menu" title=" id=ad ">top</b></article>') == "to gems and on top"
    assert kept('<article class="post category-social"><h2 id="discussion">Discussion</h2><section id="discussion">a</section><p class="social-science" id="related-work">b</p></article>') == "Discussion a b"
    assert kept("<article>a<p class='wide ad'>x</p><div id=comments>x</div><p HIDDEN>x</p><p aria-hidden = 'true'>x</p><p role=menu>x</p>b</article>") == "a b"
    assert segments("<div class='site-footer'>x</div><div data-class='ad' style='visibility:hidden'>y</div>") == [(GONE, "x"), (OPEN, "y")]


def test_implied_ends():
    kept = lambda page: [t for zone, t in segments(f"<article>{page}</article>") if zone == KEPT]
    assert kept('<p class="ad">buy<p>real <b>text<p>more text') == ["real text", "more text"]
    assert kept('<p class="ad">buy<div>real</div><p class="ad">buy<h2>more</h2>') == ["real", "more"]
    assert kept('<ul><li class="ad">x<li>real<ul><li class="ad"><p>x<li>deep</ul>after<li>more</ul>') == ["real", "deep", "after", "more"]
    assert kept('<dl><dt class="ad">x<dd>a<dd class="ad">x<dt>b</dl>') == ["a", "b"]
    assert kept('<table><tr><td class="ad">x<td>a<table><tr class="ad"><td>x<tr><td>in</table>b<th>c<tr class="ad"><td>x<tbody><tr><td>d</table>e') == ["a", "in", "b", "c", "d", "e"]
    assert segments('<p class="ad">x<p>y') == [(GONE, "x"), (OPEN, "y")]
    assert segments("<html><head><meta charset=utf-8><title>t</title><body><p>a") == segments("<head><title>t</title><p>a") == [(OPEN, "a")]


def test_boilerplate_of_a_host(spark):
    notice = "subscribe to our weekly list of very long news items today and tomorrow"
    rows = [(i, f"http://h.com/{i}", f"<div>{notice}</div><div>{' '.join(f'p{i}w{k}' for k in range(12))}</div>") for i in range(4)]
    rows += [(9, "http://other.com/", f"<p>{notice}</p>"), (10, "http://h.com/0", rows[0][2]), (11, None, None)]
    found = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1] == " ".join(f"p1w{k}" for k in range(12))
    assert found[9] == notice and found[11] == "" and found[0] == found[10] == " ".join(f"p0w{k}" for k in range(12))
