"""Mixing sources to target weights (problem 9): hierarchical budgeting over a domain-language-source tree.

Sizes are tokens. A source's weight is spread over its languages in proportion to their tokens, and a node's weight
is the sum of its children's. Budgets are handed down from the root; a node that can't use its budget, with all its
records repeated as often as allowed, leaves the rest to its siblings in proportion to their weights, and only what no
sibling can take goes to the level above. Each leaf then takes whole epochs and, of one more epoch in a seeded order,
the longest prefix of records that fits its budget. What the prefix can't use, as the next record is too large, is
spent on the records behind it that fit, in the same order, and then by the source's leaves in other languages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import VOCABULARY, with_tokens
from corvane.operators.running import running_sums
from corvane.staging import stage

#: Share of a source's budget that may stay unspent, where a record that fits it would be left.
SLACK = 0.002


@dataclass
class Node:
    """``room``: tokens it can give at most; ``weight``: its share among its siblings."""

    name: tuple[str, ...]
    weight: float
    room: float = 0.0
    children: list[Node] = field(default_factory=list)
    budget: float = 0.0

    def fill(self) -> float:
        if self.children:
            self.room = sum(c.fill() for c in self.children)
        return self.room

    def spend(self, budget: float) -> None:
        """Hand the budget down; never more than the room."""
        self.budget = min(budget, self.room)
        if not self.children:
            return
        open_, left = [c for c in self.children if c.room > 0], self.budget
        given = {id(c): 0.0 for c in self.children}
        while open_ and left > 1e-9:
            weights = sum(c.weight for c in open_) or float(len(open_))
            offers = {id(c): left * (c.weight / weights if sum(x.weight for x in open_) else 1 / len(open_)) for c in open_}
            full = [c for c in open_ if given[id(c)] + offers[id(c)] >= c.room]
            if not full:
                for c in open_:
                    given[id(c)] += offers[id(c)]
                break
            for c in full:
                left -= c.room - given[id(c)]
                given[id(c)] = c.room
            open_ = [c for c in open_ if c not in full]
        for c in self.children:
            c.spend(given[id(c)])


def budgets(leaves: list[tuple[str, str, float]], targets: dict[str, tuple[float, int]], total: float | None = None, domains: dict[str, str] | None = None) -> dict[tuple[str, str], float]:
    """Token budget of each (source, language) leaf.

    ``leaves``: available tokens per (source, language); ``targets``: share and greatest number of uses per source;
    ``total``: size of the mixture, by default the tokens of all sources with a target; ``domains``: source ->
    domain, by default one domain for all. A source without a target gets nothing.
    """
    wanted = [x for x in leaves if x[0] in targets and targets[x[0]][0] > 0]
    of_source: dict[str, float] = {}
    for source, _, size in wanted:
        of_source[source] = of_source.get(source, 0.0) + size
    tree: dict[str, dict[str, list[Node]]] = {}
    for source, lang, size in sorted(wanted):
        leaf = Node((source, lang), targets[source][0] * size / of_source[source], size * targets[source][1])
        tree.setdefault((domains or {}).get(source, ""), {}).setdefault(lang, []).append(leaf)
    above = lambda name, children: Node(name, sum(c.weight for c in children), children=children)
    root = above((), [above((d,), [above((d, lang), below) for lang, below in sorted(langs.items())]) for d, langs in sorted(tree.items())])
    root.fill()
    root.spend(sum(x[2] for x in leaves if x[0] in targets) if total is None else total)
    return {leaf.name: leaf.budget for d in root.children for lang in d.children for leaf in lang.children}


@dataclass
class Leaf:
    """What a leaf has used of its budget: whole epochs and ``taken`` tokens of one more; ``rest`` is still to be spent.
    ``fresh``: of the current epoch nothing has been taken yet."""

    size: float
    repeats: int
    budget: float
    epochs: int = 0
    rest: float = 0.0
    taken: float = 0.0
    fresh: bool = True

    def __post_init__(self) -> None:
        self.begin(self.budget)

    def begin(self, budget: float) -> None:
        self.epochs = min(self.repeats, int(budget // self.size))
        self.rest, self.taken, self.fresh = max(0.0, budget - self.epochs * self.size) if self.epochs < self.repeats else 0.0, 0.0, True

    def room(self) -> float:
        return max(0.0, (self.repeats - self.epochs) * self.size - self.taken - self.rest)

    def more(self, tokens: float) -> None:
        self.rest += tokens
        if self.taken + self.rest >= self.size:  # beyond the current epoch: all its records are used
            self.begin(self.epochs * self.size + self.taken + self.rest)


def _hand_over(leaves: dict[tuple[str, str], Leaf], closed: set[tuple[str, str]], heirs: set[tuple[str, str]]) -> None:
    """Give what the leaves ``closed`` can't spend to ``heirs`` of their source, in proportion to the room of these."""
    for name in sorted(closed):
        room = {x: leaves[x].room() for x in sorted(heirs) if x[0] == name[0]}
        whole, left = sum(room.values()), leaves[name].rest
        leaves[name].rest = 0.0
        for x, r in room.items():
            leaves[x].more(min(left, whole) * r / whole if whole else 0.0)


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: str = "mix", domains: dict[str, str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, tokens, n_uses) of every record used; a record is used once per epoch of its leaf,
    so never more often than its source's max_repeats.

    Each row of ``documents`` is a record; doc_id must be unique. A null lang is a language of its own; null sources
    and sources without target give nothing. Texts without tokens are never used. A source whose records allow it
    comes within ``SLACK`` of its budget. The driver sees one row per (source, language) of the sources with targets.
    """
    spark = documents.sparkSession
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.where("source is not null").collect()}
    counted = stage(with_tokens(documents.where(F.col("source").isin(*wanted) if wanted else F.lit(False)), "text", ["doc_id", "source", "lang"], "tokens", vocabulary).where("tokens > 0"), "tokens")
    unique = counted.withColumn("lang", F.coalesce("lang", F.lit("")))
    size = {(r["source"], r["lang"]): r["t"] for r in unique.groupBy("source", "lang").agg(F.sum("tokens").alias("t")).collect()}
    given = budgets([(*leaf, t) for leaf, t in size.items()], wanted, total, domains)
    names = sorted(given)
    leaves = {x: Leaf(float(size[x]), wanted[x[0]][1], given[x]) for x in names}
    inside = lambda some: F.col("leaf").isin(*[names.index(x) for x in sorted(some)]) if some else F.lit(False)
    fields = "leaf int, source string, lang string, epochs int, rest double, fresh boolean"
    plan = lambda: F.broadcast(spark.createDataFrame([(i, *x, leaves[x].epochs, leaves[x].rest, leaves[x].fresh) for i, x in enumerate(names)], fields))  # noqa: E731  # one row per leaf

    def unsettled(some: set[tuple[str, str]]) -> set[tuple[str, str]]:
        """Those of sources with more left to spend than SLACK."""
        left = {s: sum(leaves[x].rest for x in names if x[0] == s) - SLACK * sum(given[x] for x in names if x[0] == s) for s in wanted}
        return {x for x in some if left[x[0]] > 0}

    open_ = unsettled(set(names))
    numbered = unique.join(plan().select("leaf", "source", "lang", "epochs"), ["source", "lang"]).select("doc_id", "leaf", "tokens", "epochs", F.lit(0).alias("take"))
    done, todo = numbered.where(~inside(open_)), numbered.where(inside(open_))
    while open_:
        planned = todo.drop("epochs").join(plan().select("leaf", "epochs", "rest", "fresh"), "leaf").withColumn("take", F.when(F.col("fresh"), 0).otherwise(F.col("take")))
        fits = F.col("fresh") | ((F.col("tokens") <= F.col("rest")) & (F.col("take") == 0))
        planned = planned.withColumn("weight", F.when(fits, F.col("tokens")).otherwise(0)).withColumn("_h", F.xxhash64(F.lit(seed), "epochs", "doc_id"))
        summed = running_sums(planned, ["_h", "doc_id", "tokens"], "weight", ["leaf"])
        new = ((F.col("weight") > 0) & (F.col("running") <= F.col("rest"))).cast("int").alias("new")
        marked = stage(summed.select("doc_id", "leaf", "tokens", "epochs", "take", new), "taken")
        spent = {names[r["leaf"]]: float(r["t"]) for r in marked.groupBy("leaf").agg(F.sum(F.col("tokens") * F.col("new")).alias("t")).collect()}
        marked = marked.select("doc_id", "leaf", "tokens", "epochs", (F.col("take") + F.col("new")).alias("take"))
        # no record of these fits; of a source the one with the most left is closed, for the others to inherit
        stuck = {x for x in open_ if not leaves[x].fresh and not spent[x]}
        stuck = {max((x for x in stuck if x[0] == s), key=lambda x: (leaves[x].rest, x)) for s in {x[0] for x in stuck}}
        for x, t in spent.items():
            leaves[x].rest, leaves[x].taken, leaves[x].fresh = leaves[x].rest - t, leaves[x].taken + t, False
        _hand_over(leaves, stuck, open_ - stuck)
        still = unsettled(open_ - stuck)
        # a leaf that has begun another epoch since has used all its records in this one
        stand = plan().select("leaf", F.col("epochs").alias("now"), "fresh")
        closing = marked.where(~inside(still)).join(stand, "leaf").select("doc_id", "leaf", "tokens", F.col("now").alias("epochs"), F.when(F.col("fresh"), 0).otherwise(F.col("take")).alias("take"))
        done, todo, open_ = done.unionByName(closing), marked.where(inside(still)), still
    uses = done.select("doc_id", "leaf", "tokens", (F.col("epochs") + F.col("take")).cast("int").alias("n_uses")).where("n_uses > 0")
    return uses.join(plan().select("leaf", "source", "lang"), "leaf").select("doc_id", "source", F.nullif("lang", F.lit("")).alias("lang"), "tokens", "n_uses")


def mixture_shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, n_records, max_uses): what each source with a target reached."""
    by = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_uses")).alias("tokens"), F.count(F.lit(1)).alias("n_records"), F.max("n_uses").alias("max_uses"))
    whole = by.agg(F.sum("tokens").alias("whole"))
    joined = targets.where("source is not null").select("source", "target_share").distinct().join(by, "source", "left").crossJoin(F.broadcast(whole))  # one row
    zero = F.lit(0).cast("bigint")
    return joined.select("source", "target_share", F.coalesce("tokens", zero).alias("tokens"), (F.coalesce("tokens", zero) / F.col("whole")).alias("share"), F.coalesce("n_records", zero).alias("n_records"), F.coalesce("max_uses", F.lit(0)).alias("max_uses"))
