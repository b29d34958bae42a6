"""Operators on groups beyond the size that one task takes."""

from collections import defaultdict

import numpy as np
import pytest

from parlance.llm import op01_minhash_forest as op1
from parlance.llm import op10_html_extraction as op10


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_a_rare_notice_of_a_large_host_is_boilerplate(spark, broadcast):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    notice, twice = words("notice", 12), words("twice", 12)
    rows = []
    for k in range(1500):
        extra = f"<div>{notice}</div>" if k % 300 == 0 else f"<div>{twice}</div>" if k in (7, 8) else ""
        rows.append((k, f"http://hot/{k}", f"{extra}<div>{words(f'own{k}x', 20)}</div>" if k % 10 else f"{extra}<div>{words(f'own{k}x', 20)}</div><nav>{words('menu', 9)}</nav>"))
    rows += [(2000 + k, f"http://other/{k}", f"<div>{notice}</div><div>{words(f'own{k}y', 9)}</div>") for k in range(2)]
    rows += [(3000, None, None), (3001, "http://hot/article", f"<article>{notice}</article><p>{twice}</p>"), (3002, "http://hot/x", f"<article>a</article><p>{twice} b</p>")]
    got = {r["page_id"]: r["text"] for r in op10.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast).collect()}
    by_host = {}
    for i, url, page in rows:
        by_host.setdefault(url and url.split("/")[2], []).append((i, op10.blocks(page)))
    want = {}
    for pages in by_host.values():
        want |= dict(zip([i for i, _ in pages], op10.settle([b for _, b in pages]), strict=True))
    assert got == want
    assert got[300] == words("own300x", 20)  # on 5 of 1,500 pages
    assert got[2000].startswith(notice)  # two pages of another host


def passage_sharers(n, share, links, seed):
    """Sets of 100 that share a passage; the first ``links`` pairs of rows have a similarity of 0.8 or a little more."""
    r = np.random.default_rng(seed)
    draw = lambda k: r.integers(0, 2**63, k, dtype=np.uint64)
    passage, out = draw(share), []
    for _ in range(links):
        own = draw(100 - share)
        out += [np.unique(np.r_[passage, own]), np.unique(np.r_[passage, own[: 89 - share], draw(11)])]
    return out + [np.unique(np.r_[passage, draw(100 - share)]) for _ in range(n - len(out))]


def links_out_of_reach(sets, links, orders):
    """Links that share no candidate and no block, with so many orders of each large region."""
    low = np.array([op1.minima(x) for x in sets])
    sig, near, blocks = low.astype(np.uint8), set(), defaultdict(set)
    for tree in range(op1.TREES):
        cut = low[:, tree * op1.DEPTH : tree * op1.DEPTH + op1.LEAST].astype(">u2")
        groups = defaultdict(list)
        for i, x in enumerate(cut):
            groups[x.tobytes()].append(i)
        regions = op1.Regions(f"t{tree}")
        for at in groups.values():
            if len(at) <= op1.BLOCK:
                regions.region(np.array(at), sig[at])
            else:
                for order in range(orders):
                    regions.large(np.array(at), sig[at], tree, order)
        near |= {frozenset(map(int, p)) for p in regions.pairs}
        for _, block, i, *_ in regions.rows:
            blocks[i].add(block)
    return [k for k in range(links) if frozenset((2 * k, 2 * k + 1)) not in near and not blocks[2 * k] & blocks[2 * k + 1]]


def test_links_inside_a_region_beyond_a_block(monkeypatch):
    monkeypatch.setattr(op1, "BLOCK", 64)
    sets = passage_sharers(3000, 80, 400, 1)
    for k in range(400):
        a, b = sets[2 * k], sets[2 * k + 1]
        assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    assert len(links_out_of_reach(sets, 400, 1)) > 0  # the split by prefix alone
    assert links_out_of_reach(sets, 400, 1 + op1.ORDERS) == []


def test_few_links_are_lost_where_all_rows_nearly_match(monkeypatch):
    monkeypatch.setattr(op1, "BLOCK", 64)
    sets = passage_sharers(3000, 85, 400, 1)  # any two rows have a similarity of 0.74
    assert 5 * len(links_out_of_reach(sets, 400, 1 + op1.ORDERS)) < len(links_out_of_reach(sets, 400, 1))


def test_words_cut_here_have_the_ids_of_whole_texts(monkeypatch):
    import random

    from parlance.llm import tokens

    rng = random.Random(7)
    pools = [[chr(c) for c in range(256)], list("'stredlmvx 1,.A"), list("abcdé' \n"), list("'́aİ s日")]
    texts = ["".join(rng.choices(rng.choice(pools), k=rng.choice([0, 1, 2, 3, 8, 40, 300]))) for _ in range(1500)]
    texts += [None, "", "a", " ", "'", "it's we'llx ''s 'v", "<|endoftext|> a", "x" * 5000, " ".join(f"w{i}z" for i in range(3000))]
    usual = tokens.Encoder()
    want = usual._whole([t or "" for t in texts])
    assert usual.fast and list(usual.encode(texts)) == want
    monkeypatch.setattr(tokens, "GROUP_BYTES", 2000)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 3000)
    small = tokens.Encoder(cache_words=50)
    assert small.fast and list(small.encode(texts)) == want
    assert len(small.place) <= 50 or small.bytes <= 2 * 16_000  # one group's words at most
    one_by_one = tokens.Encoder()
    one_by_one.forget()
    one_by_one.ends[:] = False  # words that can't be told apart in one text
    assert list(one_by_one.encode(texts)) == want
