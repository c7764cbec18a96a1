"""Toxicity by a weighted finite-state grammar over the clauses of a text.

Three transducers are composed into one machine: negation (rewrites what follows a negation within its scope), reported
speech (rewrites the rest of a clause after a reporting verb) and scoring (insults, threats, and their targets). The
machine reads word classes and adds weights; a clause is scored by what it matches as a whole. Insults in any language
are learned from labelled rows, next to a small fixed lexicon.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from statloom.llm.base import query, table
from statloom.sources.landing import land, landings

# fixed values: word classes of the grammar
LEXICON = {
    "threat": "kill hurt destroy beat stab shoot burn attack töten schlagen verletzen umbringen tuer frapper brûler matar golpear quemar",
    "target": "you your yours u they them people women men du dich dir euch ihr sie tu te toi vous ils elles tú ti usted ustedes ellos",
    "negation": "not no never isn't aren't don't won't nicht kein keine nie ne pas jamais nunca jamás",
    "report": "said says wrote writes quoted claimed called sagte schrieb behauptete dit écrit dijo escribió",
    "insult": "idiot moron stupid scum loser pathetic worthless disgusting trash clown",
}
CLASSES = ("other", "insult", "threat", "target", "negation", "report")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
CLAUSE = re.compile(r"[.!?;:\n]+")
STEMS = (5, 4)
TRAIN_ROWS, TERMS = 30_000, 5_000


class Transducer:
    """``step(state, symbol) -> (state, symbol, factor)``; deterministic, weights multiply through a composition."""

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        def step(state, symbol):
            first, middle, factor = self.step(state[0], symbol)
            second, out, more = other.step(state[1], middle)
            return (first, second), out, factor * more

        return Transducer((self.start, other.start), step)

    def table(self, symbols) -> tuple[list[list[tuple[int, float]]], int]:
        """All reachable states: per state and symbol the next state and the factor of the symbol's weight."""
        number, rows, todo = {self.start: 0}, [], [self.start]
        while todo:
            state = todo.pop(0)
            row = []
            for symbol in symbols:
                after, _, factor = self.step(state, symbol)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append((number[after], factor))
            rows.append(row)
        return rows, 0


def negation(scope: int = 3) -> Transducer:
    def step(left, symbol):
        if symbol == "negation":
            return scope, symbol, 1.0
        if left and symbol in ("insult", "threat"):
            return left - 1, f"denied {symbol}", 1.0
        return max(0, left - 1), symbol, 1.0

    return Transducer(0, step)


def reported() -> Transducer:
    def step(on, symbol):
        if symbol == "report":
            return True, symbol, 1.0
        if on and symbol in ("insult", "threat"):
            return on, f"reported {symbol}", 1.0
        return on, symbol, 1.0

    return Transducer(False, step)


def scoring() -> Transducer:
    """A target makes an insult weigh more and a threat weigh at all; denied or reported matches weigh little."""

    def step(state, symbol):
        aimed, hit = state
        if symbol == "target":
            return (True, hit), symbol, 0.0
        kind = symbol.rsplit(" ", 1)[-1]
        if kind not in ("insult", "threat"):
            return state, symbol, 0.0
        factor = {"insult": 1.5 if aimed else 1.0, "threat": 2.0 if aimed else 0.2}[kind]
        factor *= 0.1 if symbol.startswith("denied") else 0.3 if symbol.startswith("reported") else 1.0
        return (aimed, True), symbol, factor * (1.2 if hit else 1.0)

    return Transducer((False, False), step)


def grammar() -> list[list[tuple[int, float]]]:
    return negation().then(reported()).then(scoring()).table(CLASSES)[0]


def fixed_words() -> dict[str, tuple[int, float]]:
    return {w: (CLASSES.index(k), 1.0) for k, words in LEXICON.items() for w in words.split()}


class Reader(dict):
    """Class and weight of a word: the word itself, else a learned stem (written with a star) that it begins with."""

    def __init__(self, words: dict[str, tuple[int, float]]):
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.words.get(word) or next((self.words[s] for n in STEMS if len(word) > n and (s := word[:n] + "*") in self.words), (0, 0.0))
        if len(self) < 500_000:
            self[word] = found
        return found


def clause_scores(text: str, machine: list[list[tuple[int, float]]], words: dict[str, tuple[int, float]]) -> list[float]:
    """Scores of the clauses that match, in order."""
    out = []
    text = text.lower()
    if not any(words[w][0] for w in set(WORD.findall(text))):
        return out
    for clause in CLAUSE.split(text):
        state, total = 0, 0.0
        for word in WORD.findall(clause):
            symbol, weight = words[word]
            state, factor = machine[state][symbol]
            total += factor * weight
        if total:
            out.append(total)
    return out


def features(scores: list[float]) -> tuple[float, float, float]:
    return (max(scores, default=0.0), math.log1p(sum(scores)), math.log1p(len(scores)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Logistic regression with a ridge, by Newton steps; the intercept comes first. Few rows give a flat model."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge * max(1, len(x)) / 100)
    pull[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (y - p) - pull * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents outside the held-out fifth, taken in the order of a digest.

    The labels kept are bounded by ``rows``, so they may be broadcast; texts are not moved.
    """
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    ids = ids.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = land(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return land(texts.join(F.broadcast(some), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"))


def learned_words(train: DataFrame, terms: int = TERMS) -> dict[str, tuple[int, float]]:
    """Words and stems that toxic rows hold far more often than others: weight from the log odds, one half added to counts."""
    size = train.agg(F.sum("toxic").alias("yes"), F.count("*").alias("n")).first()
    yes, n = float(size["yes"] or 0), float(size["n"])
    if not yes or yes == n:
        return {}
    words = train.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{Nd}\p{M}]+)"), F.lit(1)))).alias("word"))
    # a row counts once per word; the few stems that a row's words share count once per word
    stems = [F.when(F.char_length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEMS]
    words = words.select("toxic", F.explode(F.array("word", *stems)).alias("word")).where("word IS NOT NULL")
    counts = words.groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("k")).where("a >= 5")
    rate_yes, rate_no = (F.col("a") + 0.5) / (yes + 1), (F.col("k") - F.col("a") + 0.5) / (n - yes + 1)
    odds = F.log(rate_yes) - F.log(rate_no)
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("k") - F.col("a") + 0.5))
    best = counts.select("word", odds.alias("odds"), z.alias("z")).where("odds > 2.5 AND z > 4").orderBy(F.desc("z"), "word").limit(terms).collect()
    return {r.word: (CLASSES.index("insult"), min(2.0, r.odds / 4)) for r in best}


def _scorer(column: str, words: dict, beta: list[float] | None) -> Callable:
    machine, words = grammar(), Reader(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(batch.schema.get_field_index(column)):
                out.append(features(clause_scores(text.as_py() or "", machine, words)))
            found = np.array(out, dtype=np.float64).reshape(-1, 3)
            if beta is None:
                more = [pa.array(found[:, i]) for i in range(3)]
                yield pa.record_batch([*batch.columns, *more], names=[*batch.schema.names, "_f0", "_f1", "_f2"])
            else:
                score = 1 / (1 + np.exp(-np.clip(beta[0] + found @ np.array(beta[1:]), -30, 30)))
                yield pa.record_batch([*batch.columns, pa.array(score), pa.array(found[:, 1])], names=[*batch.schema.names, "_score", "_matched"])

    return run


def toxicity_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, terms: int = TERMS) -> tuple[dict, list[float]]:
    """(words, coefficients), both bounded by the parameters. Without labels of both kinds the fixed lexicon decides."""
    with landings() as own:
        train = labelled(docs, labels, rows)
        words = fixed_words() | {w: v for w, v in learned_words(train, terms).items() if fixed_words().get(w, (1,))[0] == CLASSES.index("insult")}
        found = train.mapInArrow(_scorer("text", words, None), "doc_id bigint, text string, toxic int, _f0 double, _f1 double, _f2 double").select("toxic", "_f0", "_f1", "_f2").toArrow()
        own.only()
    y = np.array(found.column("toxic"), dtype=np.float64)
    if len(y) < 20 or y.min() == y.max():
        return words, [-3.0, 4.0, 1.0, 0.0]
    return words, fitted(np.column_stack([np.array(found.column(f"_f{i}")) for i in range(3)]), y).tolist()


def with_toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """All columns of ``docs`` and ``_score`` (0 to 1, higher: more likely toxic), ``_matched`` (weight of matched clauses).

    Only the text is read for a score. A null text scores as an empty one; repeated rows score alike; an empty table
    gives no rows; null ids and null labels are never learned from; equal ids in ``labels`` count as toxic if one does.
    """
    words, beta = toxicity_model(docs, labels, **settings)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scorer("text", words, beta), f"{fields}, _score double, _matched double")


@query("op1_toxicity_grammar")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
