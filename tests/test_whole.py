"""Queries on whole rows, where the driver's SQL has no part: small tables and brute force."""

import random
import re

from parlance.functions.text import TOKEN
from parlance.operators.dedup import join_chunks
from parlance.plans import queries as q
from parlance.plans import timeline as tl


def conversations(spark, folder, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def edited(k, t):
    return [t, t.translate(str.maketrans("aeiou", "AEIOU")), t.replace("e", ""), f"{t} {t} {t}", ""][k % 5]


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


LONG = "abc " * 60 + "the bee sees élé теще the end"


def test_edits_are_judged_on_whole_texts(spark, tmp_path):
    texts = {(c, t): [LONG, "é", "one e", "теще e e e", "e" * 300][t] for c in range(5) for t in range(5)}
    d = conversations(spark, tmp_path, [(c, t, "user", x) for (c, t), x in texts.items()])
    got = {(r["conv_id"], r["turn"]): (r["distance"], r["safe"]) for r in q.QUERIES["edit_safety"](spark, d).collect()}
    want = {}
    for (c, t), a in texts.items():
        b = edited(c + t, a)
        n = distance(a, b)
        want[c, t] = (n, bool(b.strip()) and len(b) <= 2 * len(a) and len(a) <= 2 * len(b) and n <= 0.5 * max(len(a), len(b)))
    assert got == want


def test_token_diff_reads_whole_texts(spark, tmp_path):
    d = conversations(spark, tmp_path, [(2, 0, "user", LONG), (7, 0, "user", "теще e"), (5, 0, "user", LONG)])
    got = {r["conv_id"]: (r["n_diff"], r["category"]) for r in q.QUERIES["token_diff"](spark, d).collect()}
    # the, bee, sees, the and end change, in front of and behind words that do not
    assert got == {2: (10, "proper_noun_fix"), 7: (1, "proper_noun_fix"), 5: (0, "unchanged")}


def test_boundary_dedup_takes_all_tokens(spark, tmp_path):
    r = random.Random(11)
    opening = " ".join(f"o{i}" for i in range(12))
    body = lambda k: " ".join(f"b{k}x{i}" for i in range(30))
    rows = []
    for c in range(60):
        for t in range(7):
            start = opening if r.random() < 0.6 else " ".join(f"s{c}x{t}x{i}" for i in range(12))
            rows.append((c, t, "user", f"{start} {body(r.randint(0, 2))}"))
    d = conversations(spark, tmp_path, rows)
    sides = {}
    for u in tl.utterances(spark, d).orderBy("conv_id", "seq").collect():
        tail, head = sides.setdefault(u["conv_id"], ([], []))
        tokens = [w.lower() for w in re.findall(TOKEN, u["content"])]
        if u["seq"] <= 3:
            tail.append({"id": ("tail", u["seq"]), "start_ms": u["start_ms"], "end_ms": u["end_ms"], "tokens": tokens})
        if u["seq"] >= 2:
            head.append({"id": ("head", u["seq"]), "start_ms": u["start_ms"] - 20_000, "end_ms": u["end_ms"] - 20_000, "tokens": tokens})

    def dropped(most):
        out = []
        for c, both in sides.items():
            tail, head = ([x | {"tokens": x["tokens"][:most]} for x in rows_] for rows_ in both)
            kept = {x["id"] for x in join_chunks(tail, head)}
            out += [(c, *x["id"]) for x in [*tail, *head] if x["id"] not in kept]
        return sorted(out)

    assert dropped(12) != dropped(None)  # the first 12 tokens give other rows
    assert sorted(map(tuple, q.QUERIES["boundary_dedup"](spark, d).collect())) == dropped(None)
