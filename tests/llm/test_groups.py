"""Related splits, near duplicates, cross-split pairs, formatting copies: against brute force on small tables."""

import itertools
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import near_duplicates, queries, radix_groups, related, text_index
from corvane.staging import stage

WORD = re.compile(r"[^\W_]+")


def words(text):
    return set(WORD.findall((text or "").lower()))


def alike(a, b, t=0.7):
    x, y = words(a), words(b)
    return bool(x & y) and len(x & y) / len(x | y) >= t - 1e-12


def test_spanning_forest_labels_components(spark):
    rng = random.Random(1)
    nodes = [f"n{i}" for i in range(120)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)] + [("n0", "n0"), ("hub", "n1"), ("hub", "n2")] * 2 + [("hub", n) for n in nodes[80:]]
    forest, labels = related.spanning_forest(spark.createDataFrame([(n,) for n in nodes], "v string"), spark.createDataFrame(edges, "a string, b string"))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r["v"]: r["root"] for r in labels.collect()}
    assert set(got) == {*nodes, "hub"}
    for a, b in itertools.combinations(got, 2):
        assert (got[a] == got[b]) == (find(a) == find(b))
    assert forest.count() == len(got) - len(set(got.values()))  # a tree per component


CATALOG = "db_id string, author string, origin string, root string"


def test_torn_databases(spark):
    catalog = spark.createDataFrame([("A-b", " X ", None, "r"), ("c", "x", "o1", "r"), ("d", "unknown", "O1 ", "r"), ("e", "N/A", "", "r"), ("f", None, None, "r"), (None, "x", "o1", "r")], CATALOG)
    rows = [("1", "a b", "Train"), ("2", "D", " train "), ("3", "e", "dev"), ("4", "f", "dev"), ("5", "f", "Dev "), ("6", "c", None), ("7", None, "test"), ("8", "zz", "test")]
    table = lambda more: spark.createDataFrame(rows + more, "id string, db_id string, split string")
    assert related.torn_databases(catalog, table([])).count() == 0
    assert {r[0] for r in related.torn_databases(catalog, table([("9", "d", "test")])).collect()} == {"A-b", "d"}
    assert related.torn_databases(catalog.limit(0), table([])).count() == 0
    assert related.torn_databases(catalog, table([]).limit(0)).count() == 0


def test_split_records_keeps_groups_whole(spark):
    rng = random.Random(2)
    catalog = spark.createDataFrame([(f"d{i}", f"a{i // 3}", None, None) for i in range(300)], CATALOG)
    rows = [(f"r{i}", f"D{rng.randrange(300)}") for i in range(3000)] + [("x1", None), ("x2", None), ("x3", "other")] + [("r0", "d0")] * 3
    got = related.split_records(catalog, {"t": (spark.createDataFrame(rows, "id string, db_id string"), "id")}, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    by = defaultdict(set)
    for r in got:
        by[r["root"]].add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    share = Counter(r["split"] for r in got)
    assert abs(share["train"] / len(got) - 0.8) < 0.02 and abs(share["test"] / len(got) - 0.1) < 0.02


def test_deal_is_systematic(spark):
    sizes = spark.createDataFrame([(f"g{i:04}", 1 + i % 4) for i in range(2000)], "root string, n bigint")
    got = sorted(related.deal_groups(sizes, {"a": 0.5, "b": 0.3, "c": 0.2}).collect(), key=lambda r: r["root"])
    total = sum(r["n"] for r in got)
    share = Counter()
    for r in got:
        share[r["split"]] += r["n"] / total
    assert len(got) == 2000 and all(abs(share[s] - t) < 0.01 for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert related.deal_groups(sizes.limit(0), {"a": 1.0}).count() == 0


def variants(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["how", "many", "of", "the"] * 3
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(n)]
    out = []
    for text in base:
        out.append(text)
        parts = text.split()
        for _ in range(rng.randint(0, 3)):
            p = parts[:]
            if rng.random() < 0.5 and len(p) > 1:
                p[rng.randrange(len(p))] = rng.choice(vocabulary)
            rng.shuffle(p)
            out.append(" ".join(p).upper() + rng.choice(["", "!", " ?"]))
    return out


@pytest.mark.parametrize(("hot", "least"), [(64, "0.7"), (2, "0.7"), (1, "0.5")])
def test_similar_pairs_against_all_pairs(spark, monkeypatch, hot, least):
    monkeypatch.setattr(near_duplicates, "HOT", hot)
    texts = variants(random.Random(hot), 80) + ["", None, "!!!", "same same", "SAME", "alpha", "alpha beta", "beta alpha gamma"]
    rows = [(f"i{k:03}", t, "extra") for k, t in enumerate(texts)] + [("i000", texts[0], "extra"), (None, texts[0], "extra")]
    want = {(f"i{a:03}", f"i{b:03}") for a, b in itertools.combinations(range(len(texts)), 2) if alike(texts[a], texts[b], float(least))}
    got = [tuple(r) for r in near_duplicates.similar_pairs(spark.createDataFrame(rows, "id string, q string, cls string"), "id", ["q"], least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_similar_pairs_of_long_texts(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for k in range(12):
        base = [f"v{k}x{i}" for i in range(rng.choice([45, 58, 70, 300]))]
        near = base[: int(len(base) * 0.9)]
        rows += [(f"a{k:02}", " ".join(base)), (f"b{k:02}", " ".join(reversed(near)))]
        want.add((f"a{k:02}", f"b{k:02}"))
    got = {tuple(r) for r in near_duplicates.similar_pairs(spark.createDataFrame(rows, "id string, q string"), "id", ["q"]).collect()}
    assert got == want


def test_similar_pairs_need_both_texts(spark):
    rows = [("a", "x y z", "s t u"), ("b", "x y z", "s t u"), ("c", "x y z", "p q r"), ("d", "x y z", None)]
    assert [tuple(r) for r in near_duplicates.similar_pairs(spark.createDataFrame(rows, "id string, q string, s string"), "id", ["q", "s"]).collect()] == [("a", "b")]
    assert near_duplicates.similar_pairs(spark.createDataFrame([], "id string, q string"), "id", ["q"]).count() == 0


@pytest.mark.parametrize("hot", [64, 1])
def test_similar_records_of_two_texts_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(near_duplicates, "HOT", hot)
    rng = random.Random(hot)
    asked, told = variants(rng, 30), variants(rng, 12)
    long = [f"v{i}" for i in range(60)]
    rows = [(f"i{k:03}", q, rng.choice(told)) for k, q in enumerate(asked)]
    rows += [(f"k{k:02}", asked[0], " ".join(rng.sample(long, 60 - k % 14))) for k in range(30)] + [(f"l{k:02}", " ".join(long[: 60 - k % 4]), told[0]) for k in range(8)]
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if alike(a[1], b[1]) and alike(a[2], b[2])}
    got = {tuple(r) for r in near_duplicates.similar_pairs(spark.createDataFrame(rows, "id string, q string, s string"), "id", ["q", "s"]).collect()}
    assert got == want


def test_similar_groups(spark):
    rows = [("a", "one two three four"), ("b", "four three two one"), ("c", "one two three four five"), ("d", "else entirely new"), ("e", None)]
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in near_duplicates.similar_groups(spark.createDataFrame(rows, "id string, q string"), "id", ["q"]).collect()}
    assert got["a"] == got["b"] and got["a"][0] == got["c"][0] and got["a"][1] == 2
    assert got["d"][1] == got["e"][1] == 0 and len({g for g, _ in got.values()}) == 3


def test_groups_of_both_tables_against_all_pairs(spark, tmp_path):
    rng = random.Random(17)
    asked, told = variants(rng, 40), variants(rng, 12) + [None, "!"]
    spider = [(f"i{k:03}", q) for k, q in enumerate(asked[:60])]
    synthetic = [(f"i{k:03}", q, rng.choice(told)) for k, q in enumerate([*asked, *asked[:20], None])]
    spark.createDataFrame(spider + spider[:3], "example_id string, question string").write.parquet(f"{tmp_path}/mock_spider.parquet")
    spark.createDataFrame(synthetic + synthetic[:3], "synthetic_id string, question string, sql string").write.parquet(f"{tmp_path}/synthetic_record.parquet")
    got = queries.p2_groups(spark, str(tmp_path)).collect()
    for origin, rows in (("mock_spider", spider), ("synthetic_record", synthetic)):
        linked = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if all(alike(x, y) for x, y in zip(a[1:], b[1:], strict=True))]
        links, root = Counter(i for pair in linked for i in pair), {r[0]: r[0] for r in rows}
        for a, b in linked:
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
        mine = [r for r in got if r["origin"] == origin]
        assert linked and {r["id"]: r["n_links"] for r in mine} == {r[0]: links[r[0]] for r in rows} and len(mine) == len(rows)
        group = {r["id"]: r["group_id"] for r in mine}
        assert all((group[a] == group[b]) == (root[a] == root[b]) for a, b in itertools.combinations(root, 2))


def test_suffix_array_and_backward_search():
    rng = np.random.default_rng(4)
    docs = [rng.integers(100, 106, size=rng.integers(1, 9)) for _ in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    index = text_index.TextIndex.load(text_index.TextIndex(np.concatenate(docs), offsets, [f"d{i}" for i in range(40)]).dump())
    pattern = rng.integers(99, 106, size=30)
    (got,) = index.maximal_matches(index.symbols(pattern), np.array([0, 12, 12, 30]))
    order = np.argsort([len(set(d)) for d in docs], kind="stable")
    for word in range(100, 106):
        listed = index.listing(index.symbols(np.array([word, 99])))
        assert [index.names[i] for i in listed % 40] == [f"d{i}" for i in order if word in docs[i]]

    def holds(part):
        return any(tuple(part) == tuple(d[i : i + len(part)]) for d in docs for i in range(len(d) - len(part) + 1))

    for e in range(30):
        begin = 0 if e < 12 else 12
        assert got[e] == max((n for n in range(1, e - begin + 2) if holds(pattern[e - n + 1 : e + 1])), default=0)
    text = rng.integers(0, 3, size=60)
    assert text_index.suffix_array(text).tolist() == sorted(range(60), key=lambda i: text[i:].tolist())


def test_merged_spans():
    assert text_index.covered(np.array([0, 2, 3, 0, 0, 2])).tolist() == [True, True, True, False, True, True]


@pytest.mark.parametrize("shard", [2_000_000, 40])
def test_cross_split_spans_against_all_runs(spark, monkeypatch, shard):
    monkeypatch.setattr(text_index, "SHARD_SYMBOLS", shard)
    rng = random.Random(31)
    say = lambda: [f"w{min(rng.randrange(9), rng.randrange(9))}" for _ in range(rng.randint(1, 20))]
    rows = [(f"i{k:03}", " ".join(say()), None, None, rng.choice(["x", "y", None]), rng.choice(["train", "train", "dev", "Test ", None]), "clash") for k in range(60)]
    rows += [("j1", rows[0][1], None, None, "x", "train", "clash"), ("j2", None, None, None, "x", "train", "clash")]
    want = {}
    for split, name in {((r[5] or "").strip().lower(), r[4]) for r in rows if (r[5] or "").strip().lower() in ("dev", "test")}:
        texts = [r[1].split() for r in rows if (r[5] or "").strip().lower() == split and r[4] == name]
        runs = {tuple(t[i : i + k]) for t in texts for i in range(len(t)) for k in range(3, len(t) - i + 1)}
        found = []
        for r in rows:
            if r[5] == "train" and r[1]:
                t = r[1].split()
                hit = [(i, k) for i in range(len(t)) for k in range(3, len(t) - i + 1) if tuple(t[i : i + k]) in runs]
                at = sorted({p for i, k in hit for p in range(i, i + k)})
                if at:
                    found.append((sum(p - 1 not in at for p in at), len(at), max(k for _, k in hit)))
        if found:
            want[(split, name)] = (len(found), sum(f[0] for f in found), sum(f[1] for f in found), max(f[2] for f in found))
    df = spark.createDataFrame(rows + rows[:4], RECORD)
    got = {(r["split"], r["dataset_name"]): (r["n_records"], r["n_spans"], r["n_words"], r["longest"]) for r in text_index.cross_split_spans(df, 3).collect()}
    assert got == want and want
    assert text_index.cross_split_spans(df.limit(0)).count() == 0


RECORD = "id string, question string, db_id string, gold_sql string, dataset_name string, split string, side string"


def cross_rows(rng):
    texts = variants(rng, 60)
    splits = ["train", "Train ", "dev", " TEST", "held_out", None, "other"]
    return [(f"i{k:03}", t, None, rng.choice([f"select {k % 9}", f"SELECT  {k % 9};", None, " ", f"x {k}"]), "d", rng.choice(splits), "clash") for k, t in enumerate([*texts, None, "", "?"])]


def test_cross_split_pairs_against_all_pairs(spark, monkeypatch):
    rows = cross_rows(random.Random(6))
    key = lambda s: "".join(c for c in (s or "").lower() if c.isalnum() or c in "<>=!+-*/%")
    side = lambda s: {"train": 0, "dev": 1, "test": 1, "held_out": 1}.get((s or "").strip().lower())
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if {side(a[5]), side(b[5])} == {0, 1} and (alike(a[1], b[1]) or ((a[3] or "").strip() and (b[3] or "").strip() and key(a[3]) == key(b[3]))):
            want.add((a[0], b[0]))
    df = spark.createDataFrame(rows + rows[:5], RECORD)
    assert {tuple(r) for r in text_index.cross_split_pairs(df).collect()} == want and want
    monkeypatch.setattr(text_index, "SHARD_SYMBOLS", 50)
    monkeypatch.setattr(text_index, "AT_ONCE", 7)
    monkeypatch.setattr(text_index, "HELD_SYMBOLS", 30)
    assert {tuple(r) for r in text_index.cross_split_pairs(df).collect()} == want
    counts = text_index.cross_split_counts(df).collect()
    assert sum(r["n_leaked"] for r in counts if r["kind"] == "q") <= sum(r["n_records"] for r in counts if r["kind"] == "q")
    assert text_index.cross_split_pairs(df.limit(0)).count() == 0
    assert text_index.cross_split_pairs(df.where("split = 'train'")).count() == 0


def test_key_trie_counts():
    rng = random.Random(8)
    keys = [b"a\0b", b"a", b"\0", b"", *("".join(rng.choice("ab\0") for _ in range(rng.randint(0, 6))).encode() for _ in range(400))]
    trie = radix_groups.KeyTrie()
    for i, k in enumerate(keys):
        trie.add(k, 1, f"{i:04}")
    assert {k: (n, least) for k, n, least in trie.entries()} == {k: (c, f"{keys.index(k):04}") for k, c in Counter(keys).items()}


@pytest.mark.parametrize("most", [2, 50_000])
def test_formatting_copies(spark, most, monkeypatch):
    monkeypatch.setattr(radix_groups, "BUCKET_KEYS", most)
    rows = [("b", "Who? Me!", "SELECT 1;", "k"), ("a", "who me", "select  1", "k"), ("b", "Who? Me!", "SELECT 1;", "k"), ("c", "other", None, "k"), ("d", "OTHER", "", "k"), ("e", None, "x", "k"), ("f", "prefix", "s", "k"), ("g", "prefix2", "s", "k"), (None, "who me", "select 1", "k")]
    rows += [(f"h{i:03}", "hot text", "select 2", "k") for i in range(300)] + [(f"p{i:03}", "long " * 200 + str(i), "s", "k") for i in range(40)]
    raw = [json.dumps({"gold_sql": "select 1", "question": "WHO ME", "example_id": "0"}), '{ "question" : "wh\\u006f me", "gold_sql":"select 1"}', '{"question": "who me", "gold_sql": "sel', "", None, "[1]", "{'question': 'who me'}"]
    got = radix_groups.formatting_copies(spark.createDataFrame(rows, "example_id string, question string, gold_sql string, bucket string"), spark.createDataFrame([(r,) for r in raw], "payload string"))
    assert {tuple(r) for r in got.where("n_copies > 1").collect()} == {("0", 6), ("c", 2), ("h000", 300)}
    empty = radix_groups.formatting_copies(spark.createDataFrame([], "example_id string, question string, gold_sql string"), spark.createDataFrame([], "payload string"))
    assert empty.count() == 0


def test_radix_buckets_fit(spark, monkeypatch):
    monkeypatch.setattr(radix_groups, "BUCKET_KEYS", 5)
    keys = [f"{'shared ' * 9}{i % 40:02}{'x' * (i % 7)}".encode() for i in range(200)] + [b"one key"] * 30 + [b"", b"\0"]
    entries = stage(spark.createDataFrame([(k, 1, None) for k in keys], radix_groups.ENTRY))
    rows = radix_groups.radix_buckets(entries).collect()
    assert sorted(bytes(r["key"]) for r in rows) == sorted(keys) and all(bytes(r["key"]).startswith(bytes(r["bucket"])) for r in rows)
    held = defaultdict(list)
    for r in rows:
        held[bytes(r["bucket"])].append(bytes(r["key"]))
    assert all(len(v) <= 5 or len(set(v)) == 1 for v in held.values())
