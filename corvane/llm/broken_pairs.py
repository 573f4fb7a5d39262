"""Broken prompt and response pairs (problem 4).

Every distinct pair is read once: unwrapped, and told apart into nothing, a complete statement, a statement that
breaks off, a copy of the prompt, or other prose. The openings of that prose, with the prompt's own words masked, are
clustered by MinHash over their character grams; candidates are verified. An opening that recurs across unrelated
prompts and mostly carries none of their specific words is a template of declining. A classifier fitted on a bounded
sample of such answers and of answers that carry their prompts' words tells the phrasings too rare to recur. No list
of words of declining or of languages is involved: the language of a prompt is told by a model fitted on a bounded
sample of labelled texts, and prose is foreign to it if most of its words aren't those of the prompts in that language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.near_duplicates import seeded_min, similar_groups
from corvane.llm.related import spanning_forest
from corvane.llm.sql_reader import find_statement, only_literal, read, translated, unfence
from corvane.staging import stage

WORD = re.compile(r"[^\W_]+")
#: A word in at least one of so many prompts, and in so many of them, is common, any other one specific; the list of
#: common words is bounded by COMMON times a prompt's mean length.
COMMON, LEAST_COMMON = 1000, 16
#: Words of an opening; characters of its grams and similarity of a cluster; MinHash bands and their rows.
OPENING, GRAM, SIMILAR = 5, 4, 0.5
BANDS, BAND_ROWS = 12, 2
#: Unrelated prompts across which a template must recur: so many, and one in so many of all distinct prompts.
RECURS, RECURS_IN = 2, 10_000
#: Bounds of the samples that models are fitted on: answers of each kind, labelled texts of each language.
FIT_ANSWERS, FIT_TEXTS = 2000, 200
#: Share of an answer's words that must be words of the prompts of a language for it to be in that language.
AT_HOME = 0.5
#: Placeholders that stand for no answer, as word sequences.
PLACEHOLDERS = frozenset("none null nil na n a tbd tba todo fixme xxx empty blank placeholder undefined nan unknown pending missing void sql query answer".split()) | {
    "n a", "fill in later", "fill in", "fill me in", "query goes here", "query here", "sql goes here", "sql here", "your query here", "your sql here", "your code here",
    "insert query here", "insert sql here", "add query here", "answer goes here", "to do", "to be done", "to be added", "to be filled", "to be filled in", "to be determined",
    "not available", "no answer", "no query", "no sql", "no output", "coming soon", "write query here", "work in progress", "wip", "later", "select", "with",
    "left blank", "intentionally left blank", "query to be added", "add later", "see above", "same as above", "placeholder query", "empty query",
}
#: Signs of program text.
CODE = re.compile(r"=>|%>%|===|:=|\bdef \w+\(|\blambda\b|\breturn\b|\bconst\b|\bvar \w|\blet \w|\bfor \w+ in \b|\bimport\b|\bprint\(|\w\.\w+\(|\w\[['\"]|\{\s*\$?\w+\s*:|\)-\[|#include|\w+\(\w*\)\s*\{|\|>|<-|\bdf\b|\w+ (?:=|<>|>|<|LIKE) '[^'\n]*'")

FACTS = "cls string, verdict string, opening string, masked string, carries boolean, code boolean, foreign_tongue boolean"


def _squeeze(text: str) -> str:
    return "".join(WORD.findall(text.lower()))


def _grams(text: str, n: int = 3) -> set[str]:
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))} if text else set()


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer is the question, whole, nearly whole or slightly altered, whatever stands around it.

    Measured on letters and digits only: most of the answer's trigrams are the question's and at least half of
    the question's are in the answer; or as many of the words, in whatever order.
    """
    q, a = _squeeze(question), _squeeze(answer)
    if not q or not a:
        return False
    if a == q or (len(q) >= 12 and q in a and len(a) < 2.5 * len(q)):
        return True
    gq, ga = _grams(q), _grams(a)
    same = len(gq & ga)
    if same >= 0.7 * len(ga) and same >= 0.45 * len(gq):
        return True
    wq, wa = set(WORD.findall(question.lower())), set(WORD.findall(answer.lower()))
    both = len(wq & wa)
    if both >= 4 and both >= 0.7 * len(wa) and both >= 0.45 * len(wq):
        return True
    return len(wa) >= 3 and q.startswith(a)  # the question, broken off


class Tongues:
    """Which language a prompt is in: naive Bayes over the words of labelled texts, present or not."""

    def __init__(self, texts: list[tuple[str, str]]) -> None:
        self.names = sorted({lang for _, lang in texts})
        held = {lang: Counter() for lang in self.names}
        total = Counter(lang for _, lang in texts)
        for text, lang in texts:
            held[lang].update(set(WORD.findall(text.lower())))
        words = sorted(set().union(*held.values()))
        self.at = {w: i for i, w in enumerate(words)}
        self.logs = np.array([[math.log((held[lang][w] + 0.5) / (total[lang] + 1)) for lang in self.names] for w in words]).reshape(len(words), len(self.names))

    def of(self, words: set[str]) -> str:
        """The likeliest language; the first one if no word is known, "" without any labelled text."""
        known = [self.at[w] for w in words if w in self.at]
        return self.names[int(self.logs[known].sum(axis=0).argmax())] if self.names else ""


class Declining:
    """Naive Bayes over words and pairs of words, all kinds of answers equally likely: how far an answer resembles
    templates of declining rather than others. Words of neither tell nothing."""

    def __init__(self, declining: list[str], other: list[str]) -> None:
        a, b = (Counter(f for text in texts for f in self.features(text)) for texts in (declining, other))
        n, m, size = sum(a.values()), sum(b.values()), len(a.keys() | b.keys()) + 1
        self.odds = {f: math.log((a[f] + 1) / (n + size)) - math.log((b[f] + 1) / (m + size)) for f in a.keys() | b.keys()}

    @staticmethod
    def features(text: str) -> set[str]:
        words = text.split()
        return {*words, *(f"{x} {y}" for x, y in zip(words, words[1:], strict=False))}

    def score(self, text: str) -> float:
        return sum(self.odds.get(f, 0.0) for f in self.features(text))


def verdict(sql: str | None) -> tuple[str, str]:
    """(what the answer is, the text it says besides or in place of a statement).

    "empty", "complete", "broken", "translated" (a statement with keywords that are no SQL), "foreign" (another one
    that goes wrong in the middle) or "prose".
    """
    if sql is None:
        return "empty", ""
    bare = unfence(sql)
    if " ".join(WORD.findall(bare.lower())) in PLACEHOLDERS or not WORD.search(bare):
        return "empty", ""
    statement = find_statement(bare)
    if statement is not None:
        literal = only_literal(statement)
        if literal is not None and len(WORD.findall(literal)) >= 3:
            return "prose", literal
        state = read(statement)
        return ("translated" if state == "foreign" and translated(statement) else state), bare
    said = re.sub(r"(?m)^\s*(?:--|#|//|>|\*)+", " ", bare).replace("/*", " ").replace("*/", " ")
    return "prose", said


def _with_tongue(tongues: Tongues) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(tongue=[tongues.of(set(WORD.findall((q or "").lower()))) for q in pdf["question"]])

    return run


@lru_cache(maxsize=20_000)
def _read_once(sql: str) -> tuple[str, str]:
    return verdict(sql)


def carries(words: list[str], said: str, specific: set[str]) -> bool:
    """Whether an answer says one of its prompt's specific words; longer ones may stand in a run without blanks."""
    return any(w in specific for w in words) or any(len(w) >= 5 and w in said for w in specific)


def _facts(common: dict[str, frozenset[str]]) -> object:
    """``common``: the common words of the prompts of each language, and under "" those of all."""

    def prose(question: str, said: str, tongue: str) -> tuple[str, str, bool, bool, bool]:
        low = said.lower()
        prompt, words = set(WORD.findall(question.lower())), WORD.findall(low)
        masked = ["_" if w in prompt and len(w) > 3 else w for w in words]
        own = [w for w in words if w not in prompt]
        home = sum(w in common[tongue] for w in own)
        return " ".join(masked[:OPENING]), " ".join(masked), carries(words, low, prompt - common[""]), bool(CODE.search(said)), bool(prompt) and home < AT_HOME * len(own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cls, question, sql, tongue in zip(pdf["cls"], pdf["question"], pdf["sql"], pdf["tongue"], strict=True):
                kind, said = ("empty", "") if sql is None else _read_once(sql)
                if kind == "prose" and is_copy(question or "", said):
                    kind = "copy"
                out.append((cls, kind, *(prose(question or "", said, tongue) if kind == "prose" else (None, None, False, False, False))))
            yield pd.DataFrame(out, columns=["cls", "verdict", "opening", "masked", "carries", "code", "foreign_tongue"])

    return run


def _scored(model: Declining) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cls": pdf["cls"], "resembles": [model.score(t) > 0 for t in pdf["masked"]]})

    return run


def opening_clusters(openings: DataFrame) -> DataFrame:
    """(opening, root): clusters of distinct openings (column ``opening``, masked) by the similarity of their grams.

    Each MinHash bucket is read as its least opening and the openings similar to it, which are linked once verified;
    the others go on to the next round, until none is left. So a bucket of any size costs a pass a round and no pairs.
    """
    size = F.greatest(F.length("opening") - (GRAM - 1), F.lit(1))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), size), lambda i: F.xxhash64(F.substr(F.col("opening"), i, F.lit(GRAM)))))
    shingled = openings.select("opening", grams.alias("g"))
    mins = [seeded_min(F.col("g"), r) for r in range(BANDS * BAND_ROWS)]
    bands = F.array(*[F.xxhash64(F.lit(b), *mins[b * BAND_ROWS : (b + 1) * BAND_ROWS]) for b in range(BANDS)])
    left, links = stage(shingled.select("opening", "g", F.explode(F.array_distinct(bands)).alias("band")), "bands"), []
    while True:
        first = left.groupBy("band").agg(F.min(F.struct("opening", "g")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "f.opening", "f.g")
        first = first.select("band", F.col("opening").alias("a"), F.col("g").alias("h"))
        shared = F.size(F.array_intersect("g", "h"))
        similar = shared >= SIMILAR * (F.size("g") + F.size("h") - shared)
        read = stage(left.join(first, "band").where("opening <> a").select("band", "opening", "g", "a", similar.alias("similar")), "read")
        links.append(read.where("similar").select("a", F.col("opening").alias("b")))
        left = read.where("not similar").select("band", "opening", "g")
        if left.isEmpty():
            break
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    _, labels = spanning_forest(openings.select(F.col("opening").alias("v")), found.distinct())
    return labels.select(F.col("v").alias("opening"), "root")


def _sample(df: DataFrame, order: str, n: int) -> list[str]:
    """At most ``n`` values of ``order``, by their hash."""
    return [r[0] for r in df.select(order).distinct().orderBy(F.xxhash64(order), order).limit(n).collect()]


def fitted_tongues(labelled: DataFrame | None) -> Tongues:
    """The model of a bounded sample of ``labelled`` (text, lang): FIT_TEXTS texts of each language, by hash."""
    if labelled is None:
        return Tongues([])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    # a share of the texts, by hash, that holds more than FIT_TEXTS of each language with enough of them
    sizes = labelled.where("text is not null and lang is not null").groupBy("lang").count().collect()
    shares = {r["lang"]: min(1.0, 4 * FIT_TEXTS / r["count"]) for r in sizes}
    if not shares:
        return Tongues([])
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in sorted(shares.items())])
    hashed = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("_h"))
    chosen = hashed.where(F.pmod("_h", F.lit(1_000_000)) < share * 1_000_000).withColumn("_k", place).where(F.col("_k") <= FIT_TEXTS)
    return Tongues(sorted((r["text"], r["lang"]) for r in chosen.select("text", "lang").collect()))


def declining_templates(prose: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls) of the answers whose opening's cluster recurs across unrelated prompts and mostly carries none of their
    specific words. Unrelated prompts: groups of similar questions, so that small edits of one question count once."""
    clusters = opening_clusters(prose.select("opening").distinct())
    prompt = F.xxhash64("question").cast("string").alias("prompt")
    least = max(RECURS, -(-pairs.select(prompt).distinct().count() // RECURS_IN))
    said = stage(prose.join(clusters, "opening").join(pairs.select("cls", "question", prompt), "cls"), "said")
    frequent = said.groupBy("root").agg(F.count_distinct("prompt").alias("prompts"), F.avg(F.col("carries").cast("double")).alias("carried")).where((F.col("prompts") >= least) & (F.col("carried") < 0.5))
    repeated = stage(said.join(frequent.select("root"), "root", "left_semi").select("cls", "root", "prompt", "question"), "repeated")
    related = similar_groups(repeated.select("prompt", "question"), "prompt", ["question"]).select(F.col("id").alias("prompt"), "group_id")
    templates = repeated.join(related, "prompt").groupBy("root").agg(F.count_distinct("group_id").alias("groups")).where(F.col("groups") >= least)
    return stage(repeated.join(templates, "root", "left_semi").select("cls"), "templates")


def defects(records: DataFrame, key: str = "synthetic_id", labelled: DataFrame | None = None) -> DataFrame:
    """(``key``, defect_type): records whose sql is no usable answer to their question, with the first type that fits.

    Types in order: empty, refusal, copy, language, truncated. ``labelled`` (text, lang) are texts of known language;
    without them all prompts count as of one language. Rows repeated under one id count once; a null id is left out; a
    null question makes no copy and no foreign language. An empty table gives no rows.
    """
    tongues = fitted_tongues(labelled)
    members = stage(records.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "question", "sql").distinct().withColumn("cls", F.md5(F.concat_ws("\x01", F.coalesce("question", F.lit("\x02")), F.coalesce("sql", F.lit("\x02"))))), "members")
    pairs = stage(members.dropDuplicates(["cls"]).select("cls", "question", "sql").mapInPandas(_with_tongue(tongues), "cls string, question string, sql string, tongue string"), "pairs")
    prompts = stage(pairs.where("question is not null").select("question", "tongue").distinct(), "prompts")
    floor = max(LEAST_COMMON, prompts.count() // COMMON)
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w")
    counted = prompts.select("tongue", word).rollup("w", "tongue").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= floor) & F.col("w").isNotNull())
    common: dict[str, set[str]] = {x: set() for x in ("", *tongues.names)}
    for r in counted.collect():
        common[r["tongue"] or ""].add(r["w"])
    facts = stage(pairs.mapInPandas(_facts({k: frozenset(v) for k, v in common.items()}), FACTS), "facts")
    prose = facts.where("verdict = 'prose'")
    templates = declining_templates(prose, pairs)
    alike = prose.join(templates, "cls", "left_semi")
    declining = _sample(alike, "masked", FIT_ANSWERS)
    model = Declining(declining, _sample(prose.where("carries"), "masked", FIT_ANSWERS))
    # without any template nothing tells declining from another answer that says nothing of its prompt
    rest = prose.where("not carries").select("cls", "masked").mapInPandas(_scored(model), "cls string, resembles boolean") if declining else prose.select("cls", F.lit(True).alias("resembles")).where("not carries")
    judged = facts.join(templates.select("cls", F.lit(True).alias("template")), "cls", "left").join(rest, "cls", "left")
    prose_type = (
        F.when(F.coalesce("template", F.lit(False)), "refusal")
        .when(F.col("code"), "language")
        .when(~F.col("carries"), F.when(F.col("resembles") | ~F.col("foreign_tongue"), "refusal").otherwise("language"))
        .when(F.col("foreign_tongue"), "language")
        .otherwise("copy")  # prose of the question's language that says some of its specific words repeats it, altered
    )
    kind = F.when(F.col("verdict") == "prose", prose_type).when(F.col("verdict").isin("empty", "copy"), F.col("verdict")).when(F.col("verdict") == "translated", "language").when(F.col("verdict") == "broken", "truncated")
    found = judged.select("cls", kind.alias("defect_type")).where("defect_type is not null")
    return members.join(found, "cls").select(F.col("id").alias(key), "defect_type").distinct()
