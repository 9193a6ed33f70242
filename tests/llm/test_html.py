"""HTML extraction against a brute-force repeat finder, and the awkward pages."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lattisphere.llm.html_text import RUN, extract_text, segments, suffix_array

SCHEMA = "page_id long, url string, html string"


def brute_cover(streams, pages, run):
    """For each stream, which tokens lie in a run of `run` tokens that a stream of another page holds too."""
    seen = {}
    for stream, page in zip(streams, pages):
        for i in range(len(stream) - run + 1):
            seen.setdefault(tuple(stream[i : i + run]), set()).add(page)
    out = []
    for stream in streams:
        marks = [False] * len(stream)
        for i in range(len(stream) - run + 1):
            if len(seen[tuple(stream[i : i + run])]) > 1:
                marks[i : i + run] = [True] * run
        out.append(marks)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=8), st.sampled_from([1, 2, 3, 5, 8]))
def test_suffix_array_is_in_order(streams, run):
    owners = [i % 2 for i in range(len(streams))]
    at, new, prints = suffix_array(streams, owners, run)
    flat = [t for s in streams for t in s]
    owner = [o for s, o in zip(streams, owners) for _ in s]
    left = [len(s) - i for s in streams for i in range(len(s))]
    assert sorted(at) == [i for i in range(len(flat)) if left[i] >= run]
    begin = [(owner[i], tuple(flat[i : i + run])) for i in at]
    assert [bool(n) for n in new] == [k == 0 or begin[k] != begin[k - 1] for k in range(len(begin))]
    assert len(set(begin)) == int(np.sum(new))  # equal beginnings stand together
    assert len({b[1] for b in begin}) == len({int(prints[i]) for i in at})


def test_repeats_of_random_hosts(spark):
    rng = random.Random(4)
    passages = [" ".join(f"n{p}_{k}" for k in range(rng.randint(5, 30))) for p in range(12)]
    rows, expected = [], {}
    for h in range(4):
        own = []
        for i in range(25):
            blocks = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randint(0, 6)}" for _ in range(rng.randint(1, 30))) for _ in range(6)]
            own.append((100 * h + i, blocks))
        streams = [" ".join(b).split(" ") for _, b in own]
        for (page, blocks), stream, marks in zip(own, streams, brute_cover(streams, [" ".join(b) for _, b in own], RUN)):
            rows.append((page, f"http://Host{h}.org/{page}", "".join(f"<div>{b}</div>" for b in blocks)))
            expected[page] = (" ".join(t for t, m in zip(stream, marks) if not m) or " ".join(stream), sum(marks))
    for parts in (1, 7):  # one array, and many that meet by their prints
        found = extract_text(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
        assert {r.page_id: (r.text, r.n_repeated) for r in found} == expected


def test_copies_do_not_erase_each_other(spark):
    text = " ".join(f"t{k}" for k in range(40))
    article = f"<nav>{' '.join(f'm{k}' for k in range(9))}</nav><article><p>{text}</article>"
    rows = [(1, "http://a.org/1", f"<p>{text}"), (2, "http://a.org/2", f"<div>{text}</div>"), (3, "http://b.org/1", article), (4, "http://b.org/2", article), (5, "http://b.org/3", article.replace("t0 ", "u0 "))]
    rows += [(6, "http://c.org/1", f"<p>{text}"), (7, "http://c.org/2", f"<p>{text}<p>{text} more"), (7, "http://c.org/2", f"<p>{text}<p>{text} more")]
    found = {r.page_id: (r.text, r.n_repeated) for r in extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1] == found[2] == (text, 0)
    assert found[3] == found[4] == (text, None) and found[5] == (text.replace("t0 ", "u0 "), None)  # marked: no array is asked
    assert found[6] == (text, 40) and found[7] == ("more", 80)


def test_repeats_that_cross_into_marked_boilerplate(spark):
    """A repeat may begin in a menu and end in a block of unknown kind: one stream holds both."""
    rows = [(i, f"http://a.org/{i}", f"<nav>a b c d</nav><p>e f g h</p><p>own{i} text</p>") for i in range(3)]
    found = extract_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text for r in found} == {f"own{i} text" for i in range(3)}


def test_what_marked_pages_show_of_their_host(spark):
    """A menu on marked pages makes the same words on an unmarked one boilerplate."""
    menu = "home about news shop jobs help contact terms"
    rows = [(i, "http://a.org/x", f"<nav>{menu}</nav><article>text {i}</article>") for i in range(3)] + [(9, "http://a.org/y", f"<div>{menu}</div><div>only here</div>"), (10, "http://b.org/y", f"<div>{menu}</div>")]
    found = {r.page_id: (r.text, r.n_repeated) for r in extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[9] == ("only here", 8) and found[10] == (menu, 0) and found[0] == ("text 0", None)


def test_awkward_rows(spark):
    long = " ".join(f"word{k % 5000}" for k in range(200_000))
    rows = [(1, "http://a b.org/%zz", "<p>bad url", "x"), (None, None, "<p>no key", "x"), (2, "http://a.org/", f"<article>{long}</article>", "x"), (2, "http://a.org/", f"<article>{long}</article>", "x"), (3, "", None, None)]
    rows += [(4, "http://a.org/x", "<div <p>broken <b>mark<i>up</b></x> &amp; &#x41;&nbsp;&bogus; < 3 <!-- open", None), (5, "http://a.org/y", "<article><p>one\r\n\ttwo<br>three<table><tr><td>4<td>5</table><form>no</form>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumnRenamed("text", "n_chars").selectExpr("*", "n_chars AS row", "n_chars AS host")
    found = extract_text(pages).collect()
    assert len(found) == len(rows)
    texts = {}
    for r in found:
        texts.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert texts[1] == ["bad url"] and texts[None] == ["no key"] and texts[2] == [long, long] and texts[3] == [""]
    assert texts[4] == ["broken markup & A &bogus; < 3"] and texts[5] == ["one two three 4 5"]
    assert segments("<<<<>>>") and segments("</p></div>") == []
    assert extract_text(pages.limit(0)).count() == 0
