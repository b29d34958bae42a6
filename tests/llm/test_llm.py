"""The operators for training data: brute force, SQL, exact round trips, held-out accuracy, and awkward inputs."""

import html
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import op01_minhash_forest as op1
from parlance.llm import op02_quality_rules as op2
from parlance.llm import op03_sharding as op3
from parlance.llm import op04_url_filters as op4
from parlance.llm import op05_decontamination as op5
from parlance.llm import op06_packing as op6
from parlance.llm import op07_token_files as op7
from parlance.llm import op08_quality_classifier as op8
from parlance.llm import op09_language_id as op9
from parlance.llm import op10_html_extraction as op10
from parlance.llm import registry
from parlance.llm.graph import components
from tests.oracle import DATA, check, connect, rows

D = "doc_id long, text string"
FULL = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empties, blanks, ties, repeated rows and one very long text.
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, "a b c d e f g h"), (7, "A  b c\nd E f g h"), (8, "x y z " * 20_000), (None, "one"), (9, "日本語 テスト <|endoftext|> É\x1c")]
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def docs(spark, rows_=AWKWARD):
    return spark.createDataFrame(rows_, D)


def clashing(df):
    """The same rows with columns whose names the operators use themselves."""
    for c in ("shard", "slot", "kept", "rule", "host", "path", "verdict", "lang_pred", "score", "n_words", "component_id", "_w", "size"):
        df = df.withColumn(c, F.lit("mine"))
    return df


def splitmix(texts, width):
    """Sets of word shingles, plainly."""
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute_components(pairs, width, percent=80):
    ids = [i for i, _ in pairs]
    sets = splitmix([t for _, t in pairs], width)
    up = {i: i for i in ids if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if 100 * min(len(sets[a]), len(sets[b])) < percent * max(len(sets[a]), len(sets[b])):
                continue
            both = len(sets[a] & sets[b])
            if both and None not in (ids[a], ids[b]) and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                up[y] = x
    return [(i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets, strict=True)]


def near_copies(seed, groups=12, most=9):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    out = []
    for _ in range(groups):
        base = r.choices(vocab, k=r.randint(30, 160))
        for _ in range(r.randint(1, most)):
            copy = list(base)
            for _ in range(r.randint(0, len(base) // 25)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(" ".join(copy))
    return list(enumerate(out, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    pairs = near_copies(seed)
    got = op1.near_duplicates(docs(spark, pairs), width=4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(pairs, 4))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_large_group_needs_both_rounds(spark):
    pairs = near_copies(7, groups=1, most=1)
    r = random.Random(7)
    base = pairs[0][1].split() + [f"v{i}" for i in range(100)]
    for i in range(2, 120):
        copy = list(base)
        for _ in range(r.randint(1, 5)):
            copy[r.randrange(len(copy))] = f"z{i}"
        pairs.append((i, " ".join(copy)))
    got = op1.near_duplicates(docs(spark, pairs), width=4).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == sorted(brute_components(pairs, 4))


def test_near_duplicates_on_awkward_rows(spark):
    got = op1.near_duplicates(clashing(docs(spark)), width=4).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute_components(AWKWARD, 4), key=key)
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    assert op1.near_duplicates(docs(spark, [])).count() == 0


def test_regions_adapt_their_depth():
    r = np.random.default_rng(0)
    n = 3 * op1.BLOCK
    ids, sig = np.arange(n), r.integers(0, 256, (n, op1.TREES * op1.DEPTH)).astype(np.uint8)
    sig[:, op1.LEAST : op1.LEAST + 2] = 7
    sig[:, op1.LEAST + 2] = r.integers(0, 9, n)
    regions = op1.Regions("t")
    regions.large(ids, sig, 0, 0)
    sizes = defaultdict(int)
    for _, block, *_ in regions.rows:
        sizes[block] += 1
    assert max(sizes.values()) <= op1.BLOCK and len(sizes) == 9 and sum(sizes.values()) == n
    equal = op1.Regions("t")
    equal.large(ids, np.zeros_like(sig), 0, 1)
    held = defaultdict(set)
    for _, block, i, *_ in equal.rows:
        held[block].add(i)
    assert set.intersection(*held.values()) == {0} and set.union(*held.values()) == set(range(n)) and max(map(len, held.values())) <= op1.BLOCK


def test_rows_that_leave_their_partition_meet(spark, monkeypatch):
    """Regions of any size come whole out of any cut; beyond LOCAL rows they are dealt by their minima, level by level."""
    monkeypatch.setattr(op1, "BLOCK", 20)
    monkeypatch.setattr(op1, "LOCAL", 40)
    r = np.random.default_rng(1)
    sig = r.integers(0, 4, (430, op1.TREES * op1.DEPTH)).astype(np.uint8)
    sig[230:] = sig[230]  # 200 equal ones
    where = [b"\0one."] * 1 + [b"\0two."] * 19 + [b"\0thr."] * 210 + [b"\0equ."] * 200
    rows_ = [(k, i, bytes(x)) for k, i, x in zip(where, range(430), sig, strict=True)]
    got = op1.groups_of(spark.createDataFrame(rows_, "region binary, a long, sig binary").repartition(7)).collect()
    groups = defaultdict(list)
    for x in got:
        groups[bytes(x["region"]), x["order"], x["group"]].append((x["a"], x["level"]))
    by = lambda name: {k: v for k, v in groups.items() if k[0] == name}
    assert not by(b"\0one.") and [sorted(a for a, _ in v) for v in by(b"\0two.").values()] == [list(range(1, 20))]
    for order in range(op1.ORDERS + 1):
        seen = set()
        for (_, k, _), v in by(b"\0thr.").items():
            if k == order:
                level, at = v[0][1], [a for a, _ in v]
                assert len(v) <= 40 and {x for _, x in v} == {level}
                assert len(np.unique(sig[at][:, op1.COLUMN_ORDERS[0][order][:level]], axis=0)) == 1
                seen.update(at)
        alone = set(range(20, 230)) - seen  # rows that no other row meets at that depth
        assert len(seen) + len(alone) == 210 and len(seen) > 150
        pieces = [{a for a, _ in v} for (_, k, _), v in by(b"\0equ.").items() if k == order]
        assert set.union(*pieces) == set(range(230, 430)) and 230 in set.intersection(*pieces) and len(pieces) > 1


def test_hubs_and_large_blocks_are_confirmed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(op1, "HUB", 4)
    pairs = near_copies(11, groups=3, most=30)
    sets = splitmix([t for _, t in pairs], 4)
    every = [(a[0], b[0]) for k, a in enumerate(pairs) for b in pairs[:k]]
    want = {(min(a, b), max(a, b)) for a, b in every if 100 * len(sets[a - 1] & sets[b - 1]) >= 80 * len(sets[a - 1] | sets[b - 1])}
    got = op1.confirmed(spark.createDataFrame(every, "a long, b long"), docs(spark, pairs + [(1, "another text of the first id")]), 4, 80)
    assert {(x["a"], x["b"]) for x in got.collect()} == want and len(want) > 50
    rows_ = spark.createDataFrame([("x", a, 100) for a in range(40)] + [("y", a, 1) for a in range(5)], "block string, a long, n long")
    tasks = defaultdict(set)
    for x in op1.in_chunks(rows_, most=16_000).collect():
        tasks[x["block"], x["i"], x["j"]].add(x["a"])
    together = {(block, a, b) for (block, _, _), v in tasks.items() for a in v for b in v}
    assert together == {("x", a, b) for a in range(40) for b in range(40)} | {("y", a, b) for a in range(5) for b in range(5)}
    assert max(len(v) for (block, _, _), v in tasks.items() if block == "x") < 40 and len([k for k in tasks if k[0] == "y"]) == 1


@pytest.mark.parametrize("likely", [op1.LIKELY, 0.0])
def test_near_duplicates_over_many_cut_partitions(spark, likely):
    """More partitions than regions: every region touches an edge."""
    pairs = near_copies(5, groups=20, most=14)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        got = op1.near_duplicates(docs(spark, pairs), width=4, likely=likely).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(pairs, 4))


@data
def test_near_duplicates_of_a_table_match_brute_force(spark):
    """All of sf0.01: pairs of equal sizes within the limit are compared one by one."""
    folder = DATA.replace("sf0.001", "sf0.01")
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = op1.query(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(pairs, 4))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(5, 5)]
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 130)} == {100}


def test_quality_measures(spark):
    text = "a b c a b c\nrow one\nrow one\n\n#x *y|"
    m = op2.measures(docs(spark, [(1, text)])).first()
    assert (m["n_words"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], m["base_failed"]) == (12, 3, 1, 6, True)
    out = op2.quality_cascade(clashing(docs(spark))).collect()
    assert len(out) == len(AWKWARD) and not any(r["kept"] for r in out)
    assert op2.quality_cascade(docs(spark, [])).count() == 0


def test_cascade_order_does_not_change_verdicts(spark):
    r = random.Random(2)
    words = [f"{a}{b}ning" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(r.choices(words, k=80)) for _ in range(6)]
    texts += [" ".join(w.upper() + "!!" for w in r.sample(words, 80)), " ".join(w + "%%%" for w in r.sample(words, 80)), " ".join(r.sample(words, 80)) + "\nx y" * 5]
    df = docs(spark, list(enumerate(texts)))
    for rules in (op2.RULES, op2.RULES[::-1]):
        assert [x["kept"] for x in op2.quality_cascade(df, rules, order=False).orderBy("doc_id").collect()] == [True] * 6 + [False] * 3
    assert sorted(x.name for x in op2.estimate(df)) == sorted(x.name for x in op2.RULES)


def test_shards(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    out = op3.slots(op3.assign(df), ["doc_id"]).toPandas()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved["grown_shard"]) == {24} and 0.02 < len(moved) / len(out) < 0.07
    weighted = op3.assign(df, weights=[1.0, 3.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 4000 for r in weighted}
    assert 0.7 < share[1] < 0.8
    odd = op3.slots(op3.assign(clashing(docs(spark))), ["doc_id", "text"]).collect()
    assert len(odd) == len(AWKWARD) and len({(r["shard"], r["slot"]) for r in odd}) == len(AWKWARD)
    with pytest.raises(ValueError):
        op3.assign(df, weights=[1.0, 0.0])


def brute_rule(url, rules):
    """Host, path, rule and verdict of an URL, read plainly."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


URLS = ["http://A.net/x", "http://net", "http://b.example.net/en/1?q", "http://example.net/en", "x://c.org/fr/", "http://d.org/de/", "ftp://example.com/de/a/b#c", "no scheme", "", None, "http://notexample.com/de/", "http://x.example.net?en/", "://net/", "h://", "h://example.net//en/", "h://.org/fr/\n", "h://www.EXAMPLE.com/de/x/../y"]
PATHS = {"by depth": {}, "rules in a broadcast": {"most_depths": 0}, "rules shuffled": {"broadcast_rules": 0}}


@pytest.mark.parametrize("how", PATHS)
def test_url_rules(spark, how):
    rules = [*op4.RULES, ("block", "b.example.net", "/en/1"), ("allow", "org", "/fr/"), ("block", "x.y.z", "")]
    df = clashing(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"))
    for c in ("_url_row", "_short", "row", "won", "full0", "short", "salt", "digest"):
        df = df.withColumn(c, F.lit("mine"))
    out = op4.judge_urls(df, op4.rule_table(spark, rules), **PATHS[how])
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {i: brute_rule(u, rules) for i, u in enumerate(URLS)}
    assert {r["row"] for r in out.collect()} == {"mine"} and set(out.columns) == set(df.columns)
    assert op4.judge_urls(df.limit(0), op4.rule_table(spark), **PATHS[how]).count() == 0
    assert {r["verdict"] for r in op4.judge_urls(df, op4.file_rules(op4.rule_table(spark).select("verdict", "rule_host", "rule_path").limit(0)), **PATHS[how]).collect()} == {"allow"}


@pytest.mark.parametrize("how", PATHS)
def test_url_verdicts_do_not_depend_on_where_rows_are(spark, how):
    r = random.Random(5)
    urls = [f"http://{r.choice(['a.', '', 'b.c.'])}example.{r.choice(['net', 'com', 'org'])}/{r.choice(['en/', 'de/', 'fr/', ''])}{r.randint(0, 9)}" for _ in range(3000)] + ["http://a.example.net/hot"] * 1500
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [(i, *brute_rule(u, op4.RULES)[2:]) for i, u in enumerate(urls)]
    for moved in (df.repartition(7), df.repartition(5, "url"), df.dropDuplicates(["page_id"]), df.orderBy(F.rand(3)), df.unionByName(df).distinct()):
        got = op4.judge_urls(moved, op4.rule_table(spark), **PATHS[how]).select("page_id", "rule", "verdict").collect()
        assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("how", PATHS)
def test_urls_of_a_million_characters(spark, how):
    urls = ["http://" + "a." * 500_000 + "net/x", "http://example.net/en" + "/" * 1_000_000, "http://" + "." * 1_000_000 + "org/fr/" + "?" * 1000, "h" * 1_000_000, "http://example.org/" + "fr/" * 300_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = op4.judge_urls(df, op4.rule_table(spark), **PATHS[how]).select("page_id", "rule", F.length("host").alias("h"), F.length("path").alias("p")).collect()
    assert [(r["rule"], r["h"], r["p"]) for r in sorted(out)] == [("net/", 1_000_003, 2), ("example.net/en/", 11, 1_000_003), ("org/fr/", 1_000_003, 4), (None, 0, 0), ("org/fr/", 11, 900_001)]


def test_rules_need_not_end_in_a_slash(spark):
    rules = op4.rule_table(spark, [("block", "a.b", "/x/ye"), ("allow", "a.b", "/x/ye"), ("block", "b", "")])
    df = spark.createDataFrame([(1, "h://a.b/x/yes"), (2, "h://a.b/x/y"), (3, "h://a.b")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op4.judge_urls(df, rules).collect()}
    assert got == {1: ("a.b/x/ye", "block"), 2: ("b", "block"), 3: ("b", "block")}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_leaks_match_brute_force(spark, broadcast):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([3, 15, 30, 60])))) for i in range(20)] + [(50, None), (51, ""), (20, "Same, item!")]
    texts = []
    for i in range(60):
        own = r.choices(vocab, k=r.randint(0, 400))
        if i % 2:
            passage = (items[i % 20][1] or "").upper().split()
            if i % 3 == 0 and len(passage) > 20:
                passage[10] = "other"
            own[len(own) // 2 : len(own) // 2] = [p + "," for p in passage]
        texts.append((i, " ".join(own)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in op5.leaks(docs(spark, texts + AWKWARD[:3]), bench, broadcast_rows=broadcast).collect()}

    want = brute_leaks(texts, items)
    assert got == want and want


def brute_leaks(texts, items):
    """Items of which 80 % of the shingles, of five words or of all the item's words if it has fewer, occur in a text."""

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def sets(w, width):
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    out = set()
    for i, q in items:
        if words(q):
            width = min(5, len(words(q)))
            wanted = sets(words(q), width)
            out |= {(d, i) for d, t in texts if 100 * len(sets(words(t), width) & wanted) >= 80 * len(wanted)}
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_items_of_any_size_are_found(spark, broadcast):
    items = [(1, "red green blue"), (2, "Solo"), (3, "one two"), (4, "a b c d"), (5, "a b c d e"), (6, " ".join(f"long{i}" for i in range(300))), (7, "a b c d e f")]
    texts = [(1, "x " * 50 + "Red, green: BLUE " + "y " * 50), (2, "red green"), (3, "so solo."), (4, "two one two"), (5, "z a b c d e z"), (6, "q " * 3000 + items[5][1] + " q" * 3000), (7, None), (8, ""), (9, "red green x blue")]
    texts += [(10, items[5][1].replace("long7 ", "other ")), (11, " ".join(f"long{i}" for i in range(230)))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts] + [(1, None, "x", 1), (1, "blue", "x", 1), (None, "solo", "x", 1)], "doc_id long, text string, w string, item int")
    out = op5.leaks(df, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast, broadcast_ids=broadcast)
    assert {(x["doc_id"], x["item_id"]) for x in out.collect()} == brute_leaks(texts, items) >= {(1, 1), (3, 2), (4, 3), (6, 6), (10, 6)}
    assert op5.leaks(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert op5.leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def whole_ids(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_packing_cuts_every_id_once(spark):
    r = random.Random(1)
    rows_ = AWKWARD + [(100 + i, " ".join(r.choices(["alpha", "it's", "Ünïx", "9,9", "zzqq"], k=r.randint(1, 3000)))) for i in range(60)]
    out = op6.pack(clashing(docs(spark, rows_))).collect()
    ids = defaultdict(list)
    for (i, _), x in zip(rows_, whole_ids([t for _, t in rows_], 1), strict=True):
        ids[i].append(x)
    seen = defaultdict(list)
    for p in out:
        match = [x for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"] and crc(x[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"]]
        assert match
        seen[p["doc_id"]].append(p["length"])
    assert all(sum(seen[i]) == sum(map(len, xs)) for i, xs in ids.items())
    bins = defaultdict(list)
    for p in out:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for ps in bins.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(x["length"] for x in out) > 0.9 * 2048 * (len(bins) - 3)
    assert op6.pack(docs(spark, [])).count() == 0


def test_open_pieces_are_merged_in_a_tree(spark, monkeypatch):
    """Many tasks and small groups: several levels, every id once, little padding."""
    monkeypatch.setattr(op6, "GROUP_ROWS", 8)
    r = random.Random(3)
    rows_ = [(i, " ".join(r.choices(["alpha", "beta", "zzqq"], k=r.choice([20, 70, 90, 400, 700])))) for i in range(600)]
    out = op6.pack(docs(spark, rows_).repartition(40)).toPandas()
    assert (out.groupby("doc_id")["length"].sum() == out.groupby("doc_id")["doc_tokens"].first()).all() and out["doc_id"].nunique() == 600
    for _, ps in out.groupby("sequence_id"):
        ps = ps.sort_values("offset")
        assert ps["offset"].tolist() == [0, *ps["length"].cumsum()[:-1]] and ps["length"].sum() <= 2048
    assert out["length"].sum() > 0.95 * 2048 * (out["sequence_id"].nunique() - 8)


def test_pieces_are_harmonic():
    for n in range(1, 6000, 7):
        ps = op6.pieces(n)
        assert [a for a, _, _ in ps] == [sum(x[1] for x in ps[:k]) for k in range(len(ps))] and sum(x[1] for x in ps) == n
        assert all(length * k <= 2048 and (k == 32 or length * k >= 0.96 * 2048 - k) for _, length, k in ps)


def test_token_files_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    manifest = op7.write_token_files(clashing(docs(spark)), path)
    got = [(r["doc_id"], r["n_tokens"], r["ids_crc32"], r["start"]) for r in op7.read_token_files(spark, path).orderBy("start").collect()]
    order = sorted(AWKWARD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, at = [], 0
    for (i, _), ids in zip(order, whole_ids([t for _, t in order], 2), strict=True):
        want.append((i, len(ids), crc(ids), at))
        at += len(ids)
    assert got == want and manifest["tokens"] == at
    part = op7.TokenFile(path, next(p["file"] for p in manifest["parts"] if p["docs"]))
    k = len(part.index) - 1
    assert part.ids(k) == list(part.all_ids())[k]
    op7.write_token_files(docs(spark, []), f"{path}-empty")
    assert op7.read_token_files(spark, f"{path}-empty").count() == 0


def test_a_damaged_token_file_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    name = next(p["file"] for p in op7.write_token_files(docs(spark), path)["parts"] if p["docs"])
    whole = (tmp_path / "ids" / name).read_bytes()
    (tmp_path / "ids" / name).write_bytes(whole[:-3])
    with pytest.raises(ValueError):
        op7.TokenFile(path, name)


@data
def test_classifier_held_out(spark):
    out = op8.query(spark, DATA.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/labels.parquet")
    both = out.join(labels, "doc_id").where(op9.held_out()).toPandas()
    assert ((both["quality_score"] >= 0.5) == (both["quality"] == 1)).mean() >= 0.97


def test_classifier_on_awkward_rows(spark):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in [*AWKWARD, (30, "word " * 300_000)]], FULL)
    none = spark.createDataFrame([], "doc_id long, quality int")
    features = op8.featured(clashing(df))
    out = op8.score_documents(clashing(df), op8.fit(features, none)).collect()
    assert len(out) == len(AWKWARD) + 1 and {r["quality_score"] for r in out} == {0.5} and {r["score"] for r in out} == {"mine"}
    one = spark.createDataFrame([(4, 1), (4, 0), (6, 1)], "doc_id long, quality int")
    assert {r["quality_score"] for r in op8.score_features(features, op8.fit(features, one)).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i, _ in AWKWARD if i], "doc_id long, quality int")
    mixed = op8.fit(features, both)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_score"])
    a, b = (sorted(x.collect(), key=key) for x in (op8.score_features(features, mixed), op8.score_documents(df, mixed)))
    assert [r["quality_score"] for r in a] == [r["quality_score"] for r in b] and a[0]["doc_id"] is None
    assert op8.score_documents(df.limit(0), op8.fit(op8.featured(df.limit(0)), none)).count() == 0


def test_the_surest_documents_match_brute_force(spark):
    """Pseudo-labels come from all unlabelled rows, over any number of tasks, ties and repeated rows included."""
    r = random.Random(6)
    rows_ = [(i, " ".join(r.choices(["fine", "word", "!!!", "$$"], k=r.randint(1, 40))), f"s{i % 5}", "en", i % 50) for i in range(900)]
    features = op8.featured(spark.createDataFrame(rows_ + rows_[:100], FULL).repartition(9))
    pdf = features.toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    y = np.array([float("$$" not in x[1]) for x in rows_])
    views = [op8.View.fit(x, y, x, y) for x in (op8.matrix(pdf["t"]), op8.meta_matrix(pdf))]
    surest, gone = op8.surest_of(features), set()
    for _ in range(2):
        want = []
        for v, x in enumerate((op8.matrix(pdf["t"]), op8.meta_matrix(pdf))):
            p = op8.sigmoid(views[v].odds(x))
            for kind, sure, most in ((1, p, 30), (0, 1 - p, 20)):
                ranked = sorted((-s, i) for s, i in zip(sure, pdf["doc_id"], strict=True) if s >= op8.SURE and i not in gone)
                want += [(i, v, kind) for _, i in ranked[:most]]
        first = {}
        for i, v, kind in want:
            first.setdefault(i, (v, kind))
        got = surest(views, 30, 20)
        assert [sum(1 for x in first.values() if x[0] == v) for v in (0, 1)] == [len(g[2]) for g in got]
        assert sorted(x[1] for x in first.values()) == sorted(int(z) for g in got for z in g[2])
        gone |= set(first)


def test_the_text_view_reads_words():
    view, base = op8.TextView(), "abcd efgh ijkl"
    one, two = (op8.matrix([view(t)])[0] for t in (base, "efgh abcd mnop"))
    assert np.allclose(one[: op8.STATISTICS], two[: op8.STATISTICS]) and not np.allclose(one, two)


@data
def test_language_held_out(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    both = op9.query(spark, folder).join(spark.read.parquet(folder + "/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (both["lang"] == both["lang_pred"]).mean() >= 0.98 and both["score"].between(0, 1).all()


def test_language_on_awkward_rows(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("кот и собака", "ru"), ("x", None), (None, "fr"), ("12", "es")], "text string, lang string")
    profiles = op9.learn(train)
    assert profiles.languages == ["de", "en", "ru"]
    rows_ = AWKWARD + [(20, "und der"), (21, "123 !?"), (22, "собака"), (23, "und der"), (23, "und der"), (24, "the dog " * 100_000)]
    df = clashing(docs(spark, rows_)).withColumn("row", F.lit("mine")).withColumn("p", F.lit("mine"))
    got = op9.identify(df, profiles).collect()
    out = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(rows_) and {r["row"] for r in got} == {r["p"] for r in got} == {"mine"}
    assert out[(1, None)] == out[(2, "")] == out[(21, "123 !?")] == ("und", 0.0) and out[(20, "und der")][0] == "de"
    assert out[(22, "собака")][0] == "ru" and out[(20, "und der")] == out[(23, "und der")] and out[(24, "the dog " * 100_000)][0] == "en"
    nothing = op9.identify(docs(spark, [(1, "abc")]), op9.learn(train.limit(0))).first()
    assert (nothing["lang_pred"], nothing["score"]) == ("und", 0.0)
    assert op9.identify(df.limit(0), profiles).count() == 0


def test_bundles_match_brute_force(spark):
    """Binding, bundling and cosines, letter by letter; n-grams that training never saw count too."""
    train = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("one more", "en")]
    tests = ["a dog", "Ein Hund!", "zzqx ñandú", "кот", "the\n\n cat", "q"]
    letters = op9.Space().placed[op9.N - 1]

    def vector(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        flat, total = " " + " ".join(words) + " ", np.zeros(op9.DIMENSIONS)
        for i in range(len(flat) - 2):
            bound = np.ones(op9.DIMENSIONS)
            for place in range(3):
                c = flat[i + place]
                bound = bound * np.roll(letters[op9.letter_code(ord(c)) if c != " " else 0], 2 - place)
            total += bound
        return total

    protos = {la: sum(vector(t) for t, x in train if x == la) for la in ("de", "en")}
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    profiles = op9.learn(spark.createDataFrame(train, "text string, lang string").repartition(3))
    for r in op9.identify(spark.createDataFrame([(t,) for t in tests], "text string"), profiles).collect():
        near = {la: cosine(vector(r["text"]), p) for la, p in protos.items()}
        assert r["lang_pred"] == max(near, key=near.get) and abs(r["cosine"] - max(near.values())) < 1e-4
        assert abs(r["score"] - 1 / (1 + np.exp(-op9.SHARPNESS * abs(near["en"] - near["de"])))) < 1e-3


def test_a_rare_language_is_learnt_from_all_of_its_texts(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "IF(id % 400 = 1, 'xx', IF(id % 7 = 0, NULL, 'en')) AS lang")
    allowed = df.where(~op9.held_out() & F.col("lang").isNotNull())
    got = {r["lang"]: r["count"] for r in op9.training_rows(df, per_language=300).groupBy("lang").count().collect()}
    assert got["xx"] == allowed.where("lang = 'xx'").count() and 200 < got["en"] < 400
    assert [r["lang"] for r in op9.training_rows(df, languages=1).select("lang").distinct().collect()] == ["en"]


def test_the_language_stage_rejects(spark):
    en, de = "the cat and the dog walk over the street and back to the house ", "der hund und die katze gehen über die strasse und zurück zum haus "
    rows_ = [(i, (en if i % 2 else de) * 5 + str(i), "en" if i % 2 else "de", "s", 1) for i in range(40)]
    rows_ += [(100, en * 5, "de", "s", 1), (101, en * 5, None, "s", 1), (102, "1 2 3 " * 50, "en", "s", 1), (103, None, None, "s", 1), (104, "qzx wvk jjq xkcd " * 20, None, "s", 1)]
    df = spark.createDataFrame(rows_, FULL).withColumn("lang_pred", F.lit("mine")).withColumn("stated", F.lit("mine"))
    out = op9.stage(spark, df, "")
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {*range(40), 101}
    assert op9.stage(spark, df.limit(0), "").count() == 0


PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a>Menu</a></li></ul></nav>
<div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text<br>and<p>second
line</p><aside>side</aside><form><input>go</form><!-- no --><style>p{}</style></article><section id="comments"><p>Me too</p></section><footer>&copy; x</footer></body></html>"""


def main_text(page):
    return op10.settle([op10.blocks(page)])[0]


def test_article_text():
    assert main_text(PAGE) == "Title & more\nFirst bold text and\nsecond line"
    assert [main_text(x) for x in (None, "", "<p></p>", "plain <b", "<div>a<p>b")] == ["", "", "", "plain", "a\nb"]


def test_what_wraps_the_article_does_not_hide_it():
    assert main_text("<form><div><article><p>Body</p></article></div></form>") == "Body"
    assert main_text("<form><div><article><p>Body</p>") == "Body"
    assert main_text('<div class="search-results ads"><article>Body</article></div>') == "Body"
    assert main_text('<section id="comments"><main>Body</main></section><div class="ad">Buy</div>') == "Body"
    assert main_text("<div><p>Real body</p></div><article><h2>Teaser</h2></article>") == "Real body\nTeaser"
    assert main_text('<article><div class="notice"><p>kept</p></div><p>more</p></article>') == "kept\nmore"
    assert main_text("<article><h1>T</h1><p>x</p><article>a comment</article><section id=comments>another</section></article><div>menu</div>") == "T\nx"
    assert main_text("<form><p>Name</p></form><p>text</p>") == "text"


def test_broken_markup_is_read_in_linear_time():
    import time

    n = 20_000
    pages = ["<div>" * n + "</p>" * n, "<div>" * n + "</b></x>" * n, "<a 'x>" * n + "<p>y", '<a "x> ' * (n + 1), "<!--" * n, "<b " * n, "<div class=" * n, "<script>" * n, "'\"<x " * n, "<article>" * n + "x", "<form>" * n + "x<p>y" * n, "<form><article>" * n + "x<p>y" * n, "word " * 10 * n]
    began = time.perf_counter()
    for page in pages:
        op10.blocks(page)
    assert time.perf_counter() - began < 10
    assert main_text("<p>a<!-- never ends") == "a" and main_text("<p>a < b <b>c") == "a < b c"
    assert main_text("<a title='it's>x</a><p>y") == "x\ny" and main_text("</p></div>x<p>y</article>") == "x\ny"


def brute_host(pages, core):
    """The whole query on one host, read plainly: every run of 8 tokens of every page against all pages."""
    read = []
    for page in pages:
        found = op10.blocks(page)
        own = op10.plain_core(found) if core else None
        ts = [(kind, t.split(" ")) for kind, t, _ in found if not (own and kind.startswith("core"))]
        read.append((own, ts))
    seen = defaultdict(set)
    for _, ts in read:
        flat = tuple(w for _, ws in ts for w in ws)
        for i in range(len(flat) - 7):
            seen[flat[i : i + 8]].add(flat)
    out = []
    for own, ts in read:
        flat = tuple(w for _, ws in ts for w in ws)
        covered = [any(len(seen[flat[i : i + 8]]) >= 3 for i in range(max(0, p - 7), min(p, len(flat) - 8) + 1)) for p in range(len(flat))]
        at, kept, every = 0, [], []
        for kind, ws in ts:
            share = sum(covered[at : at + len(ws)]) / len(ws)
            at += len(ws)
            if kind != "chrome":
                every.append(" ".join(ws))
                kept += [" ".join(ws)] * (share < 0.5)
        out.append("\n".join(own or kept or every))
    return out


@pytest.mark.parametrize("core", [True, False])
def test_the_whole_query_matches_brute_force(spark, core):
    r = random.Random(8)
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    shared = [f"<div>{words(f'boiler{k}x', r.randint(4, 20))}</div>" for k in range(6)]
    rows_ = []
    for k in range(160):
        body = "".join(f"<p>{words(f'own{k}p{j}x', r.randint(1, 15))}</p>" for j in range(r.randint(0, 3)))
        body = r.choice([body, f"<article><h1>t</h1>{body}</article>", f"<article>{body}</article>", f"<form>{body}</form>"])
        parts = [*r.sample(shared, r.randint(0, 3)), body, f"<nav>{words(f'menu{k % 4}x', 9)}</nav>", r.choice(["", "<p>one tail</p>"])]
        r.shuffle(parts)
        rows_.append((k, f"http://host{k % 3}/{k}", "".join(parts)))
    rows_ += [(500 + k, rows_[k][1], rows_[k][2]) for k in range(10)]
    want = {}
    for h in range(3):
        own = [x for x in rows_ if x[1].startswith(f"http://host{h}/")]
        want |= dict(zip([x[0] for x in own], brute_host([x[2] for x in own], core), strict=True))
    df = spark.createDataFrame(rows_, "page_id long, url string, html string").repartition(5)
    assert {x["page_id"]: x["text"] for x in op10.extract(df, core=core).collect()} == want


@data
def test_the_text_of_pages_is_their_article():
    import duckdb

    for (page,) in duckdb.sql(f"SELECT html FROM '{DATA}/pages.parquet'").fetchall():
        inside = re.search(r"(?s)<article>(.*?)</article>", page)[1]
        parts = [" ".join(html.unescape(re.sub(r"(?s)<b>|</b>|<!--.*?-->", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert main_text(page) == "\n".join(x for x in parts if x)


def test_pages_without_an_article_lose_what_their_host_repeats():
    shared = " ".join(f"boiler{i}" for i in range(12))
    pages = [op10.blocks(f"<div>{shared}</div><div>{' '.join(f'own{k}x{i}' for i in range(20))}</div>") for k in range(4)]
    assert op10.settle(pages) == [" ".join(f"own{k}x{i}" for i in range(20)) for k in range(4)]
    assert op10.settle(pages[:2])[0].startswith(shared)  # two pages are no host yet


def test_repeated_runs_match_brute_force():
    r = random.Random(3)
    for _ in range(30):
        streams = [r.choices(range(3), k=r.randint(0, 25)) for _ in range(r.randint(1, 6))]
        got = op10.repeated(streams, run=4, pages=3)
        grams = defaultdict(set)
        for s in streams:
            for i in range(len(s) - 3):
                grams[tuple(s[i : i + 4])].add(tuple(s))
        for s, cover in zip(streams, got, strict=True):
            want = [any(len(grams[tuple(s[i : i + 4])]) >= 3 for i in range(max(0, p - 3), min(p, len(s) - 4) + 1)) for p in range(len(s))]
            assert cover.tolist() == want


def articles_of_a_host():
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    notice, passage, copied = words("notice", 12), words("passage", 12), words("copied", 40)
    out = {}
    for k in range(12):
        own = words(f"own{k}x", 30)
        out[k] = f"<nav>menu</nav><article><h1>t{k}</h1><p>{own}</p><div>{notice}</div><p>{passage}</p></article>", f"t{k}\n{own}\n{passage}"
    for k in range(20, 24):  # near copies without paragraphs
        out[k] = f"<article><h1>c</h1><div>{copied}</div><div>{words(f'end{k}x', 9)}</div></article><div>{notice}</div>", f"c\n{copied}\n{words(f'end{k}x', 9)}"
    out[30] = out[31] = f"<article><h1>u</h1><div>{words('twice', 12)}</div><p>x</p></article>", f"u\n{words('twice', 12)}\nx"
    return out


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_the_array_judges_articles_too(spark, monkeypatch, broadcast):
    """A notice that articles of a host hold goes; passages in paragraphs, copies, and what two pages share stay."""
    monkeypatch.setattr(op10, "SORTED", 100, raising=False)  # several buckets
    pages = articles_of_a_host()
    assert op10.settle([op10.blocks(page) for page, _ in pages.values()]) == [text for _, text in pages.values()]
    rows_ = [(k, f"http://h/{k}", page) for k, (page, _) in pages.items()] + [(100 + k, f"http://g{k}/{k}", page) for k, (page, _) in pages.items()]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in op10.extract(df, broadcast).collect()}
    assert {k: got[k] for k in pages} == {k: text for k, (_, text) in pages.items()}
    assert all("notice0" in got[100 + k] for k in range(12))  # hosts of one page
    assert op10.extract(df.limit(0), broadcast).count() == 0


def test_suffixes_travel_whole():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**op10.BITS, 5000, dtype=np.uint64)
    keys, counts = op10.summed(np.r_[keys, keys[:3000], keys[:1000], keys[:500]], np.ones(9500, np.int64))
    assert len(keys) == 5000 and sorted(set(counts)) == [1, 2, 3] and (counts == 3).sum() == 1000
    back = op10.unpack(op10.pack(keys, counts))
    assert (back[0] == keys).all() and (back[1] == counts).all()
    assert [len(x) for x in op10.unpack(op10.pack(keys[:0], counts[:0]))] == [0, 0]
    filed = np.zeros(2**op10.FILTER // 8, np.uint8)
    op10.filter_bits(filed, keys[::2])
    assert op10.may_hold(filed, keys[::2]).all() and op10.may_hold(filed, keys[1::2]).mean() < 0.01


def test_pages_through_spark(spark):
    rows_ = [(1, "http://h/a", PAGE), (2, None, None), (2, None, None), (3, "http://h/b", "")] + [(10 + i, "http://big/x", f"<main><p>page {i}</p></main>") for i in range(150)]
    out = op10.extract(clashing(spark.createDataFrame(rows_, "page_id long, url string, html string"))).collect()
    assert len(out) == len(rows_) and {r["text"] for r in out if r["page_id"] == 2} == {""}
    assert {r["text"] for r in out if r["page_id"] >= 10} == {f"page {i}" for i in range(150)}
    assert html.unescape("&amp;") in next(r["text"] for r in out if r["page_id"] == 1)


@data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name], connect())


@data
def test_pipeline_keeps_clean_documents(spark):
    """Each stage against a plain reading of it, on what the stage before kept."""
    import corpus_pipeline as pipeline

    con = connect()
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "benchmark decontamination", "packing"]
    steps, left = dict(pipeline.STAGES), spark.read.parquet(f"{DATA}/documents.parquet")
    kept = steps["quality rules"](spark, left, DATA)
    assert {r["doc_id"] for r in kept.collect()} == {x[0] for x in con.sql(f"SELECT doc_id FROM ({op2.ORACLE}) WHERE kept").fetchall()}
    spoken = steps["language ID"](spark, kept, DATA)
    judged = op9.identify(kept.select("doc_id", "text", F.col("lang").alias("stated")), op9.learn(op9.training_rows(kept))).toPandas()
    fine = judged[(judged["lang_pred"] != "und") & (judged["cosine"] >= 0.25) & (judged["stated"].isna() | (judged["stated"] == judged["lang_pred"]))]
    assert spoken.columns == left.columns and {r["doc_id"] for r in spoken.collect()} == set(fine["doc_id"]) and len(fine) >= 0.98 * len(judged)
    one = steps["MinHash near-dedup"](spark, spoken, DATA)
    pairs = [(r["doc_id"], r["text"]) for r in spoken.collect()]
    assert {r["doc_id"] for r in one.collect()} == {c for _, _, c in brute_components(pairs, 5)}
    clean = steps["benchmark decontamination"](spark, one, DATA)
    con.register("left_docs", one.toPandas())
    leaked = {x[0] for x in con.sql(op5.leaks_sql("left_docs")).fetchall()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - leaked
    packed = pipeline.run(spark, DATA).toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in clean.collect()}
    assert rows(packed[["doc_id", "doc_tokens"]].drop_duplicates()) and packed.groupby("sequence_id")["length"].sum().max() <= 2048
