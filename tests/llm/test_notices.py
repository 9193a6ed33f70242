"""Host suffix arrays over marked main text, against a brute-force counter of runs."""

import random

from lattisphere.llm.html_text import NOTICE_PAGES, RUN, extract_text

SCHEMA = "page_id long, url string, html string"


def brute_notices(pages, run):
    """{page: (text, tokens left out)} of the marked pages of one host, given as {page: blocks}."""
    texts = {" ".join(blocks) for blocks in pages.values()}
    holders = {}
    for text in texts:
        tokens = text.split(" ")
        for i in range(len(tokens) - run + 1):
            holders.setdefault(tuple(tokens[i : i + run]), set()).add(text)
    notices = {w for w, held in holders.items() if 2 * len(held) > len(texts) and len(held) >= NOTICE_PAGES}
    out = {}
    for page, blocks in pages.items():
        tokens = [(t, k) for k, b in enumerate(blocks) for t in b.split(" ")]
        gone = [False] * len(tokens)
        for i in range(len(tokens) - run + 1):
            if tuple(t for t, _ in tokens[i : i + run]) in notices:
                gone[i : i + run] = [True] * run
        rest = [k for k in range(len(blocks)) if not all(g for g, (_, b) in zip(gone, tokens) if b == k)]
        n = sum(len(b.split(" ")) for k, b in enumerate(blocks) if k not in rest)
        out[page] = (" ".join(blocks[k] for k in rest), n) if 2 * n < len(tokens) else (" ".join(blocks), 0)
    return out


def test_arrays_find_notices_in_marked_text(spark):
    """No name tells them: the arrays do, one for a host as well as many that meet by their prints."""
    rng, rows, expected = random.Random(7), [], {}
    for h, (n, share) in enumerate([(40, 0.95), (40, 0.55), (40, 0.45), (9, 0.9), (7, 1.0), (40, 0.6)]):
        notice = [" ".join(f"n{h}_{k}" for k in range(w)) for w in (4, 7, 9, 12)]  # the first two are long only together
        passage, own = " ".join(f"s{h}_{k}" for k in range(15)), {}
        for i in range(n):
            blocks = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 40))) for _ in range(3)]
            blocks += [passage] * (rng.random() < 0.3)  # articles share it
            blocks[1:1] = [b for j, b in enumerate(notice) if rng.random() < share or j == 1 and blocks[0] == notice[0]]
            if h == 5:
                blocks = [*notice, f"near copy {i}"]  # most of the text is common, so it is no notice
            own[100 * h + i] = blocks
        own[100 * h + 90] = own[100 * h]  # a copy is no page of its own
        expected |= brute_notices(own, RUN)
        rows += [(page, f"http://host{h}.org/{page}", f"<nav>menu {page}</nav><article>{''.join(f'<p>{b}' for b in blocks)}</article>") for page, blocks in own.items()]
    left_out = [n for _, n in expected.values()]
    assert sum(map(bool, left_out)) > 80 and not any(expected[500 + i][1] for i in range(40)) and not any(expected[400 + i][1] for i in range(7))
    for parts, array in ((1, 10**9), (5, 10**9), (5, 300)):
        found = extract_text(spark.createDataFrame(rows, SCHEMA).repartition(parts), array=array).collect()
        assert {r.page_id: (r.text, r.n_notice) for r in found} == expected and len(found) == len(rows)
        assert {r.n_repeated for r in found} == {None}


def test_large_hosts_in_several_arrays(spark):
    """Repeats of unmarked pages are the same whether a host has one array or many."""
    rng = random.Random(8)
    passages = [" ".join(f"n{p}_{k}" for k in range(rng.randint(5, 30))) for p in range(40)]
    rows = [(i, "http://a.org/", "".join(f"<div>{rng.choice(passages) if rng.random() < 0.3 else ' '.join(f'w{rng.randint(0, 99)}' for _ in range(20))}</div>" for _ in range(5))) for i in range(120)]
    pages = spark.createDataFrame(rows, SCHEMA)
    one, many = ({r.page_id: (r.text, r.n_repeated, r.n_notice) for r in extract_text(pages.repartition(3), array=a).collect()} for a in (10**9, 500))
    assert one == many and sum(n for _, n, _ in one.values()) > 1000
