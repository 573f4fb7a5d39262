"""Broken pairs, passages, percentiles, samples, mixtures and pieces."""

import datetime as dt
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import broken_pairs, mixing, passage_index, percentiles, pieces, queries, stable_sample, tokens
from corvane.llm.sql_reader import find_statement, only_literal, read, unfence

COMPLETE = ["SELECT 1", "select a from t", "SELECT count(*) FROM t WHERE a = 'x' AND b >= 3;", "WITH p AS (SELECT a FROM t) SELECT max(a) FROM p WHERE a < 4", "SELECT a FROM t WHERE a NOT IN (SELECT b FROM u WHERE c = 'o''h (') ORDER BY a DESC LIMIT 3", "SELECT T1.a, T2.b FROM x AS T1 JOIN y AS T2 ON T1.k = T2.k", "SELECT sum(CASE WHEN a > 1 THEN 1 ELSE 0 END) * 1.0 / count(*) FROM t GROUP BY b HAVING count(*) >= 2", "SELECT a FROM t UNION ALL SELECT b FROM u", "SELECT rank() OVER (PARTITION BY a ORDER BY b) FROM t", "SELECT [a b], \"c\" FROM `t` LIMIT 5", "SELECT a FROM t -- done", "SELECT a FROM größe_t; -- Anzahl"]


@pytest.mark.parametrize("sql", COMPLETE)
def test_reader_accepts_complete_statements(sql):
    assert read(sql) == "complete"


BROKEN = ["SELECT", "SELECT a,", "SELECT a", "SELECT a FROM", "SELECT a FROM t WH", "SELECT a FROM t WHERE", "SELECT a FROM t WHERE b", "SELECT a FROM t WHERE b =", "SELECT a FROM t WHERE b = 'x", "SELECT a FROM t WHERE b IN (1, 2", "SELECT a FROM t WHERE b NOT", "SELECT a FROM t GROUP", "SELECT a FROM t GROUP BY a HAV", "SELECT a FROM t GROUP BY a HAVING count(*)", "SELECT a FROM t ORDER B", "SELECT a FROM t LIMIT", "SELECT sum(CASE WHEN a > 1 THEN", "WITH p AS (SELECT a FROM t)", "WITH p AS (SELECT a", "SELECT a FROM t WHERE b = 1 AND", "SELECT a FROM t WHERE b = 1 AND...", "SELECT a FROM x AS T1 JOIN"]


@pytest.mark.parametrize("sql", BROKEN)
def test_reader_sees_where_statements_break_off(sql):
    assert read(sql) == "broken"


def test_unwrapping():
    assert read(find_statement(unfence("Here is the query:\n```sql\nSELECT a FROM t\n```"))) == "complete"
    assert read(find_statement("/* not able (yet */ WITH p AS (SELECT 1 AS a) SELECT a FROM p")) == "complete"
    assert find_statement("-- SELECT a FROM t") is None
    assert only_literal("SELECT 'I can''t do this.' AS x;") == "I can't do this."
    assert only_literal("SELECT 1;") is None
    assert read("SELECT " + "(" * 5000 + "1" + ")" * 5000) in ("complete", "broken")


Q = "How many boats did Zorvanil register in Pelutaby?"
CASES = [
    (Q, None, "empty"), (Q, " \t​", "empty"), (Q, "```sql\n```", "empty"), (Q, "-- TODO", "empty"), (Q, "N/A", "empty"), (Q, ";;", "empty"),
    (Q, "I'm sorry, but I cannot help with boats.", "refusal"), (Q, "SELECT 'Es tut mir leid, das kann ich nicht.';", "refusal"), (Q, "```\n-- Lo siento, no puedo escribir esto.\n```", "refusal"),
    (Q, "-- " + Q, "copy"), (Q, "Question: how many boats did Zorvanl register in Pelutaby", "copy"), (Q, Q + " " + Q, "copy"), (Q, "How many boats did Zorvanil", "copy"),
    (Q, "Man nimmt die Tabelle boat und zählt alle Einträge für Zorvanil.", "language"), (Q, "df = load('boat')\nprint(len(df[df.owner == 'Zorvanil']))", "language"), (Q, "WÄHLE a AUS boat WO b = 'Zorvanil';", "language"),
    (Q, "SELECT count(*) FROM boat WHERE owner = 'Zorv", "truncated"), (Q, "Sure!\nSELECT count(*) FROM boat WHERE", "truncated"),
    (Q, "SELECT count(*) FROM boat", None), (Q, "-- " + Q + "\nSELECT count(*) FROM boat;", None), (Q, "-- sorry, slow\nSELECT 1 FROM boat", None), (Q, "Here is the query:\nSELECT a FROM boat WHERE b <> 'I cannot say';", None), (None, "SELECT a FROM boat", None), (None, None, "empty"),
]


def test_defects(spark):
    rows = [(f"c{i:02}", q, s, "clash") for i, (q, s, _) in enumerate(CASES)] * 2 + [(None, Q, None, "clash")]
    # other prompts, from which the words of prompts and the phrases of declining are known
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
    said = ["I'm sorry, but I cannot help with trams.", "Es tut mir leid, das kann ich nicht.", "Lo siento, no puedo escribir esto."]
    rows += [(f"d{i:02}", f"How many boats did {name()} register in {name()}?", said[i % 3] if i < 12 else "SELECT 1;", "clash") for i in range(30)]
    got = [tuple(r) for r in broken_pairs.defects(spark.createDataFrame(rows, "synthetic_id string, question string, sql string, cls string")).collect()]
    assert len(got) == len(set(got)) and {k for i, k in got if i[0] == "d"} == {"refusal"} and sum(i[0] == "d" for i, _ in got) == 12
    got = [r for r in got if r[0][0] == "c"]
    assert dict(got) == {f"c{i:02}": kind for i, (_, _, kind) in enumerate(CASES) if kind}
    assert broken_pairs.defects(spark.createDataFrame([], "synthetic_id string, question string, sql string")).count() == 0


def test_partly_translated_statements_are_another_language(spark):
    told = ["SELECT a DESDE t DONDE b = 'x'", "SELECT a FROM t DONDE b = 'x'", "SELECT a FROM t WHERE b = 'x' ORDENAR POR c", "SELECT count(*) AUS t WO b >= 3 GRUPPIERE NACH c;", "SELECT a FROM t GRUPPIERE NACH c"]
    whole = ["SELECT a FROM t WHERE b = 'x' This query lists all of the boats.", "SELECT a FROM t ORDER BY a WHERE b = 'x'", "SELECT a FROM t WHERE b ILIKE 'x'", "SELECT a FROM t QUALIFY x = 1", "SELECT a FROM t\nDas zählt alle Boote aus der Tabelle"]
    rows = [(f"{k}{i}", Q, s) for k, texts in (("t", told), ("w", whole)) for i, s in enumerate(texts)]
    got = {r[0]: r[1] for r in broken_pairs.defects(spark.createDataFrame(rows, "synthetic_id string, question string, sql string")).collect()}
    assert got == {f"t{i}": "language" for i in range(len(told))}


def test_unknown_refusals_are_found_by_recurrence(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
    asked = [f"Show all {name()} of {name()} near {name()}" for _ in range(60)]
    rows = [(f"r{i:02}", q, "That topic stays closed to me today and tomorrow as well." if i < 10 else "SELECT a FROM t;") for i, q in enumerate(asked)]
    got = {r[0]: r[1] for r in broken_pairs.defects(spark.createDataFrame(rows, "synthetic_id string, question string, sql string")).collect()}
    assert got == {f"r{i:02}": "refusal" for i in range(10)}


def test_variants_of_one_question_are_no_unrelated_prompts(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
    rows = [(f"s{i:02}", f"Show all boats of {name()} near {name()} harbour sorted by age", "That topic stays closed to me today." if i < 6 else "SELECT a FROM t;") for i in range(40)]
    asked = ["Show all boats of Zorvanil near Pelutaby harbour sorted by age", "Show all boats of Zorvanil near Pelutaby harbour ordered by age", "Please show all boats of Zorvanil near Pelutaby harbour sorted by age", "List all boats of Zorvanil near Pelutaby harbour sorted by age"]
    rows += [(f"r{i}", q, "Man nimmt die Tabelle und zählt alle Einträge nach dem Filter.") for i, q in enumerate(asked)] + [("x", asked[0], "Today that topic stays closed.")]
    got = {r[0]: r[1] for r in broken_pairs.defects(spark.createDataFrame(rows, "synthetic_id string, question string, sql string")).collect()}
    assert got == {f"r{i}": "language" for i in range(4)} | {f"s{i:02}": "refusal" for i in range(6)} | {"x": "refusal"}


def test_opening_clusters_read_a_hot_bucket_whole(spark):
    said = [f"we must decline to give {w}" for w in ("boats", "trams", "hubs", "ships", "hives")] + ["entirely different words here now"]
    got = {r["opening"]: r["root"] for r in broken_pairs.opening_clusters(spark.createDataFrame([(x,) for x in said], "opening string")).collect()}
    assert len({got[x] for x in said[:5]}) == 1 and got[said[5]] != got[said[0]]


def test_tongues_are_told_by_labelled_texts(spark):
    texts = [("the rows of the table are in order", "en"), ("which of the tables is there", "en"), ("die Zeilen der Tabelle sind in Ordnung", "de"), ("wie viele Tabellen sind es", "de"), (None, "de"), ("x", None)]
    model = broken_pairs.fitted_tongues(spark.createDataFrame(texts, "text string, lang string"))
    assert model.names == ["de", "en"] and model.of({"wie", "viele", "zorvanil"}) == "de" and model.of({"which", "of", "the"}) == "en"
    assert broken_pairs.fitted_tongues(None).of({"x"}) == broken_pairs.fitted_tongues(spark.createDataFrame([], "text string, lang string")).of(set()) == ""


def test_passages_against_all_windows(spark, monkeypatch):
    rng = random.Random(11)
    say = lambda n: [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) if rng.random() < 0.9 else f"w{rng.randrange(300)}" for _ in range(n)]
    items = [(i, say(rng.randint(5, 40))) for i in range(30)]
    docs = []
    for d in range(120):
        text = say(rng.randint(0, 60))
        _, source = rng.choice(items)
        cut = rng.randint(0, len(source))
        text += source[cut : cut + rng.randint(3, 20)] + say(rng.randint(0, 20))
        docs.append((d, ", ".join(text).title()))
    docs += [(500, None), (501, ""), (502, "_ - _"), (503, docs[3][1]), (None, docs[3][1])]
    grams = lambda w: {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, w in items if d is not None and grams(passage_index.text_words(t or "")) & grams(w)}
    frame = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id bigint, text string, item_id string").repartition(3)
    passages = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(None, "x"), (99, None)], "item_id bigint, text string")
    assert {tuple(r) for r in passage_index.leaked_items(frame, passages).collect()} == want and want
    exact = passage_index.passage_matches(frame, passages).collect()
    by = {r: passage_index.text_words(t or "") for r, t in docs}
    told = dict(items)
    for r in exact:
        assert r["n_words"] >= 12
        assert by[r["doc_id"]][r["doc_word"] : r["doc_word"] + r["n_words"]] == told[r["item_id"]][r["item_word"] : r["item_word"] + r["n_words"]]
    near = {(r["doc_id"], r["item_id"]) for r in passage_index.passage_matches(frame, passages, slop=2).where("match_type = 'proximity'").collect()}
    assert near >= want
    monkeypatch.setattr(passage_index, "SHARD_WORDS", 100)
    monkeypatch.setattr(passage_index, "AT_ONCE", 13)
    monkeypatch.setattr(passage_index, "BLOCK_WORDS", 100)
    assert {tuple(r) for r in passage_index.leaked_items(frame, passages).collect()} == want
    assert passage_index.leaked_items(frame.limit(0), passages).count() == passage_index.leaked_items(frame, passages.limit(0)).count() == 0


def test_proximity_of_edited_passages_against_all_places(spark, monkeypatch):
    rng = random.Random(21)
    say = lambda n, prefix: [f"{prefix}{min(rng.randrange(60), rng.randrange(60))}" for _ in range(n)]
    items = [(i, say(rng.randint(12, 30), "w")) for i in range(12)]
    docs = []
    for d in range(60):
        _, source = rng.choice(items)
        quoted = source[:]
        for k in range(rng.randint(3, 6), len(quoted), 6):  # no run of 12 known words is left
            quoted[k : k + rng.randint(0, 1)] = say(1, "typo")
        docs.append((d, say(rng.randint(0, 9), "x") + rng.choice([quoted, quoted[::-1], source, source[: len(source) // 2]]) + say(rng.randint(0, 9), "w")))
    docs = [(d, w) for d, w in docs if len(w) >= 12]
    counts, slop, missing = Counter(w for _, words in docs for w in words), 3, 2
    want = set()
    for (d, words), (i, told) in itertools.product(docs, items):
        for f in range(len(told) - 11):
            rare = sorted(range(12), key=lambda k: counts[told[f + k]])[: missing + 1]
            for at in {p - k for p, w in enumerate(words) for k in rare if w == told[f + k]}:
                near = sum(told[f + k] in words[max(0, at + k - slop) : max(0, at + k + slop + 1)] for k in range(12))
                if near >= 12 - missing:
                    want.add((d, i))
    swapped = [(d, i) for d, i in want if not any(told[f : f + 12] == words[p : p + 12] for told in [dict(items)[i]] for words in [dict(docs)[d]] for f in range(len(told) - 11) for p in range(len(words) - 11))]
    assert swapped
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string").repartition(2)
    passages = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    rows = sorted(tuple(r) for r in passage_index.passage_matches(frame, passages, slop=slop, missing=missing).collect())
    assert {r[:2] for r in rows if r[2] == "proximity"} == want
    exact = sorted(tuple(r) for r in passage_index.passage_matches(frame, passages).collect())
    assert [r for r in rows if r[2] == "phrase"] == exact and {r[:2] for r in exact} < want
    monkeypatch.setattr(passage_index, "AT_ONCE", 7)  # a run may not be cut where a part ends
    assert sorted(tuple(r) for r in passage_index.passage_matches(frame, passages, slop=slop, missing=missing).collect()) == rows
    assert sorted(tuple(r) for r in passage_index.passage_matches(frame, passages).collect()) == exact


def test_a_passage_with_one_word_changed_is_near(spark):
    told = [f"w{i}" for i in range(12)]
    docs = [(1, " ".join(told[:5] + ["other"] + told[6:])), (2, " ".join(told[:5] + told[6:])), (3, " ".join(told[::-1])), (4, " ".join(told[:4] + ["more"] + told[4:])), (5, " ".join(told[:8]) + " a b c d")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = passage_index.passage_matches(frame, spark.createDataFrame([(7, " ".join(told))], "item_id bigint, text string"), slop=3).collect()
    assert {(r["doc_id"], r["match_type"]) for r in got} == {(1, "proximity"), (4, "proximity")}  # 2 is shorter than a window


def test_percentiles_stay_in_their_bounds(spark):
    rng = random.Random(5)
    rows = []
    for model, n in (("a", 2000), ("b", 7), (None, 50)):
        for _ in range(n):
            value = rng.choice([0.0, 30000.0, None, rng.lognormvariate(6, 2), -rng.random(), float("nan"), float(round(rng.random() * 50))])
            rows.append((model, rng.choice([dt.datetime(2025, 1, 1, 5), dt.datetime(2025, 1, 2, 6), None]), value, "clash"))
    rows.append(("c", dt.datetime(2025, 1, 1), None, "clash"))
    got = percentiles.daily_percentiles(spark.createDataFrame(rows, "m string, at timestamp, v double, period string"), ["m"], "v", "at").collect()
    assert "c" not in {r["m"] for r in got}
    seen = 0
    for r in got:
        day = lambda t: None if t is None else t.date()
        values = sorted(v for m, t, v, _ in rows if m == r["m"] and v is not None and v == v and (r["scope"] == "all" or day(t) == r["day"]))
        exact = values[max(1, math.ceil(r["percentile"] * len(values))) - 1]
        assert r["n_values"] == len(values) and r["low"] <= exact <= r["high"]
        assert abs(r["value"] - exact) <= percentiles.RELATIVE_ERROR * 1.0001 * abs(exact)
        seen += 1
    assert seen == len(got) == 4 * 12
    assert percentiles.daily_percentiles(spark.createDataFrame([], "m string, at timestamp, v double"), ["m"], "v", "at").count() == 0


def test_states_of_parts_merge(spark):
    rows = spark.range(1000).select(F.lit("g").alias("m"), (F.col("id") % 10).cast("string").alias("p"), F.col("id").cast("double").alias("v"))
    whole = percentiles.merge_counts(percentiles.value_counts(rows, ["m"], "v", F.col("p")), ["m"])
    parts = [percentiles.value_counts(rows.where(c), ["m"], "v", F.col("p")) for c in ("v < 300", "v >= 300")]
    merged = percentiles.merge_counts(parts[0].unionByName(parts[1]), ["m"])
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in merged.collect()}


def test_sample_is_stable(spark):
    rows = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("x"))
    chosen = {r["k"] for r in stable_sample.stable_sample(rows, "k", 0.1).collect()}
    assert 400 < len(chosen) < 600
    more = rows.union(rows.limit(100)).union(spark.range(5000, 7000).select(F.concat(F.lit("k"), "id"), F.lit(1))).repartition(9)
    again = stable_sample.stable_sample(more, "k", 0.1)
    assert {r["k"] for r in again.collect()} >= chosen
    assert {r["k"] for r in again.collect()} & {f"k{i}" for i in range(5000)} == chosen
    assert chosen <= {r["k"] for r in stable_sample.stable_sample(rows, "k", 0.2).collect()}
    nulls = spark.createDataFrame([(None,), (None,)], "k string")
    assert stable_sample.stable_sample(nulls, "k", 1.0).count() == 2
    assert stable_sample.stable_sample(nulls, "k", 0.5).count() in (0, 2)
    assert stable_sample.stable_sample(rows, "k", 0.0).count() == 0
    with pytest.raises(ValueError, match="rate"):
        stable_sample.stable_sample(rows, "k", 1.5)


def test_budgets_redistribute_among_siblings_first():
    leaves = [("a", "en", 100.0), ("a", "de", 100.0), ("b", "en", 1000.0), ("c", "en", 500.0), ("c", "de", 500.0), ("z", "en", 5.0)]
    targets = {"a": (0.5, 1), "b": (0.25, 1), "c": (0.25, 1), "gone": (0.1, 1)}
    found = mixing.budgets(leaves, targets, 800.0)
    # of each language's part what a can't use goes to the language's other sources
    assert found[("a", "en")] == found[("a", "de")] == 100.0
    assert found[("c", "de")] == pytest.approx(800 * 0.375 - 100) and found[("b", "en")] == pytest.approx(400 * 2 / 3) and sum(found.values()) == pytest.approx(800)
    domains = mixing.budgets(leaves, targets, 800.0, {"a": "x", "b": "x", "c": "y"})
    assert domains[("b", "en")] == pytest.approx(400.0) and domains[("c", "en")] + domains[("c", "de")] == pytest.approx(200.0)
    assert sum(mixing.budgets(leaves, targets, 1e9).values()) == 2200.0
    assert mixing.budgets([], targets) == {}


def test_every_source_with_room_comes_close_to_its_budget(spark):
    rng = random.Random(8)
    docs = [(i, "w " * rng.choice([5, 20, 70, 3000]), rng.choice(["en", "de"]), rng.choice("ab")) for i in range(600)]
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 2)], "source string, target_share double, max_repeats int")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    shares = {r["source"]: r for r in mixing.mixture_shares(mixing.mixture(frame, targets), targets).collect()}
    assert abs(shares["a"]["share"] - 0.2) < 0.002 and shares["b"]["max_uses"] == 2
    # a record that its leaf's rest can't hold leaves its tokens to the source's other languages, through more epochs
    few = [(1, "w " * 1000, "zh", "a")] + [(i, "w " * 9, "en", "a") for i in range(2, 40)] + [(i, "w " * 50, "en", "b") for i in range(50, 90)]
    frame = spark.createDataFrame(few, "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("a", 0.5, 8), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    reached = {r["source"]: r["tokens"] for r in mixing.mixture_shares(mixing.mixture(frame, targets, 4000.0), targets).collect()}
    assert 1985 <= reached["a"] <= 2000 and 1950 <= reached["b"] <= 2000


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["w ", "xy z "]) * rng.randint(1, 30), rng.choice(["en", "de", None]), "big" if i < 400 else "small", 7) for i in range(440)]
    docs += [(900, None, "en", "big", 7), (901, "", "en", "big", 7), (902, "lost", "en", None, 7), (903, "lost", "en", "unlisted", 7)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    used = mixing.mixture(frame, targets)
    rows = used.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} == {"big", "small"}
    assert max(r["n_uses"] for r in rows if r["source"] == "small") <= 3 and max(r["n_uses"] for r in rows if r["source"] == "big") == 1
    shares = {r["source"]: r for r in mixing.mixture_shares(used, targets).collect()}
    assert abs(sum(r["share"] for r in shares.values()) - 1) < 1e-9 and shares["absent"]["n_records"] == 0
    assert {tuple(r) for r in mixing.mixture(frame.repartition(7), targets).collect()} == {tuple(r) for r in rows}
    assert mixing.mixture(frame.limit(0), targets).count() == mixing.mixture(frame, targets.limit(0)).count() == 0


def natural(rng):
    line = lambda: " ".join(rng.choice(["alpha", "beta", "Zorvanil", "selects", "rows", "größe"]) for _ in range(rng.randint(3, 18))) + rng.choice([".", "?", ",", ""])
    return rng.choice(["\n", "\r\n", "\r"]).join(rng.choice(["", "# Head ", "## Head ", "- ", "  - ", "1. ", "| a | ", "```\n", "    ", ""]) + line() for _ in range(rng.randint(1, 40)))


def test_pieces(spark):
    rng = random.Random(12)
    texts = [natural(rng) for _ in range(60)] + ["x" * 5000, "查询平均值没有提示，问题。" * 80, "naïve " * 300, "\n" * 900, "😀" * 300, "ab\n\n" * 200, "", None, "short", "   " * 400 + "end"]
    docs = [(i, t, 1) for i, t in enumerate(texts)]
    limits = [(1, 40, 8), (2, 64, 0), (3, 64, 32)]
    got = pieces.pieces(spark.createDataFrame(docs, "doc_id bigint, text string, piece_no int"), spark.createDataFrame([*limits, (4, None, 0)], "limit_id int, max_tokens int, overlap_tokens int")).collect()
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["limit_id"]), []).append(r)
    for i, t, _ in docs:
        count = len(tokens.encode(t, tokens.VOCABULARY)) if t else 0
        for limit, most, overlap in limits:
            rows = sorted(by.get((i, limit), []), key=lambda r: r["piece_no"])
            assert bool(rows) == (count > most)
            if not rows:
                continue
            assert [r["piece_no"] for r in rows] == list(range(1, len(rows) + 1))
            assert all(r["n_tokens"] <= most and len(tokens.encode(r["piece"], tokens.VOCABULARY)) <= most for r in rows)
            (whole,) = pieces.analysed([t], tokens.VOCABULARY)
            cut, last = pieces.pack(whole, most, overlap), 0
            assert [r["piece"] for r in rows] == [whole.slice(b, e) for b, e, _ in cut]
            for k, (begin, end, _) in enumerate(cut):
                assert begin <= last < end and (k == 0 or overlap <= last - begin <= overlap + 3)
                last = end
            assert last == whole.n
            if overlap == 0:
                assert "".join(r["piece"] for r in rows) == t
    with pytest.raises(ValueError, match="half"):
        pieces.pieces(spark.createDataFrame(docs[:1], "doc_id bigint, text string, x int"), spark.createDataFrame([(1, 40, 30)], "limit_id int, max_tokens int, overlap_tokens int"))


def test_pieces_cut_at_natural_boundaries(spark):
    text = "\n\n".join(f"# Part {i}\n" + "A sentence about rows. " * 12 for i in range(6))
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = pieces.pieces(frame, spark.createDataFrame([(1, 80, 0)], "limit_id int, max_tokens int, overlap_tokens int")).orderBy("piece_no").collect()
    assert [r["boundary"] for r in got] == ["h1"] * 5 + ["end"]
    assert "".join(r["piece"] for r in got) == text


def packed(text, most, overlap=0):
    (whole,) = pieces.analysed([text], tokens.VOCABULARY)
    return [(whole.slice(b, e), boundary) for b, e, boundary in pieces.pack(whole, most, overlap)]


def test_a_fence_has_no_headings():
    code = "".join(f"# comment {i}\nvalue = call(one, two, {i})\n" + "\n" * (i % 3 == 2) for i in range(20))
    text = f"Some words before the code.\n\n```python\n{code}```\n# After\nThe text goes on.\n"
    got = packed(text, 60)
    assert "".join(t for t, _ in got) == text and all(b in ("item 4", "line", "h1", "end", "block") for _, b in got)
    assert [b for t, b in got if t.rstrip().endswith("```")] == ["h1"] and sum(b == "item 4" for _, b in got) > 3
    unclosed = packed("~~~\n" + code, 60) + packed("# A\n" + "words " * 70, 60)
    assert not any(b == "h1" for _, b in unclosed)


def test_no_piece_joins_the_children_of_two_parents():
    say = lambda n: "rows and columns of a table " * n + "\n"
    text = f"# A\n{say(3)}## A1\n{say(6)}## A2\n{say(2)}# C\n{say(2)}# D\n{say(1)}"
    got = packed(text, 60)
    assert "".join(t for t, _ in got) == text
    assert not any("## A2" in t and "# C" in t for t, _ in got) and got[-1][0].startswith("# C")
    nested = "- one " + "a " * 20 + "\n" + "".join(f"  - part {i} " + "b " * 14 + "\n" for i in range(4)) + "- two " + "c " * 20 + "\n"
    got = packed(nested, 48)
    assert "".join(t for t, _ in got) == nested and got[-1][0].startswith("- two") and {b for _, b in got} <= {"item 1", "item 2", "end"}


def test_queries_and_sql_have_the_same_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert all(re.match(r"p\d+_", name) for name in queries.queries())
