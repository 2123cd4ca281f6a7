"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, report or other. Transducers rewrite the stream of a clause's symbols:
an insult near a target becomes an aimed insult, one in the scope of a negation a negated one, one in that of reported speech a
reported one, and a threat needs a target. The transducers are composed into one automaton, whose arcs carry weights. A clause scores
the weight of its path; clauses whose emissions are all negated or reported are deflected and score nothing. A logistic model, fitted
on labels, weighs what the clauses of a text score; deflected clauses can't raise it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import bounded_batches, materialise, own_worker, text_batches

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: What a clause emits: insult, aimed insult, threat, negated and reported ones.
PLAIN, AIMED, THREATENED, NEGATED, REPORTED = range(5)

# Seeds of the symbol classes in four languages. Insults are completed from labels.
SEEDS = {
    INSULT: "idiot idiots moron morons scum loser losers clown clowns trash worthless pathetic stupid disgusting dumb imbecile vermin filth coward liar "
    "dumm dummkopf trottel abschaum versager idiote imbécile crétin ordure minable idiota imbécil estúpido basura patético",
    THREAT: "kill hurt destroy beat punch shoot stab crush töten vernichten erschießen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours youre he she they them him her his their everyone people du dich dir ihr euch sie vous toi tu ils elles tú usted ustedes ellos ellas",
    NEGATION: "not no never isnt arent wasnt dont doesnt didnt without nicht kein keine keinen ohne ne pas jamais sans nunca sin jamás",
    REPORT: "said says say called calls wrote writes claimed claims quoted reported alleged according sagte sagt nannte schrieb dit disait écrit appelé dijo dice escribió llamó",
}
#: Bounds: labelled documents that the model is fitted on, learned terms; least documents of a term and least share of the toxic ones;
#: least lower bound of log odds; pieces that a task remembers; times that a term counts in a text.
SAMPLE_DOCS, MOST_TERMS, LEAST_DOCS, LEAST_SHARE, LEAST_ODDS, MOST_PIECES, MOST_TIMES = 20_000, 50_000, 4, 0.005, math.log(8), 200_000, 5
SCOPE = {TARGET: 3, NEGATION: 3, REPORT: 6}
#: How the grammar weighs an emission: insult, aimed insult, threat; negated and reported ones weigh nothing.
ARC = (1.0, 1.5, 1.5, 0.0, 0.0)
#: Weight of a threat, also where its target emits it.
THREAT_WEIGHT = 2.0
STEMS = (3, 4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
CLAUSE_ENDS = re.compile(r"[.!?;:]$")


def scope_rule(trigger: int, rewrites: dict[int, int], reach: int):
    """A transducer as a function (state, symbol) -> (state, symbol): within `reach` words after the trigger, symbols are rewritten."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        if symbol == trigger:
            return reach, symbol
        return max(0, state - 1), (rewrites.get(symbol, symbol) if state else symbol)

    return step


def threat_rule(reach: int):
    """The transducer of a threat that its target follows within `reach` words: the target emits it."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        if symbol == TARGET and state:
            return 0, 10 + THREATENED
        return (reach if symbol == THREAT else max(0, state - 1)), symbol

    return step


START = (0, 0, 0, 0)


def composed() -> dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], int]]:
    """The composition of the transducers, as one table over (states, symbol). Symbols 10 + x are emissions x."""
    rules = [
        scope_rule(TARGET, {INSULT: 10 + AIMED, THREAT: 10 + THREATENED}, SCOPE[TARGET]),
        threat_rule(SCOPE[TARGET]),
        scope_rule(NEGATION, {INSULT: 10 + NEGATED, 10 + AIMED: 10 + NEGATED, 10 + THREATENED: 10 + NEGATED}, SCOPE[NEGATION]),
        scope_rule(REPORT, {INSULT: 10 + REPORTED, 10 + AIMED: 10 + REPORTED, 10 + THREATENED: 10 + REPORTED, 10 + NEGATED: 10 + REPORTED}, SCOPE[REPORT]),
    ]
    table, todo = {}, [START]
    while todo:
        states = todo.pop()
        for symbol in range(6):
            out, new = symbol, []
            for rule, state in zip(rules, states, strict=True):
                state, out = rule(state, out)
                new.append(state)
            if (states, symbol) not in table:
                table[states, symbol] = (tuple(new), out)
                todo.append(tuple(new))
    return table


GRAMMAR = composed()


class Reader(dict):
    """Symbol and weight of each piece between white space: (symbol, weight, ends a clause); read once a task, bounded."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.seeds = {w: k for k, words in SEEDS.items() for w in words.split()}

    def __missing__(self, piece: str) -> tuple[int, float, bool]:
        if len(self) > MOST_PIECES:
            self.clear()
        best = (OTHER, 0.0)
        for w in WORD.findall(piece.replace("'", "").lower()):
            weight = max((self.lexicon.get(t, 0.0) for t in term_forms(w)), default=0.0)
            kind = self.seeds.get(w, OTHER)
            if kind == INSULT or (kind == OTHER and weight > 0):
                best = max(best, (INSULT, max(weight, 2.0 if kind == INSULT else 0.0)), key=lambda x: x[1])
            elif kind and not best[1]:
                best = (kind, THREAT_WEIGHT if kind == THREAT else 0.0)
        self[piece] = out = (*best, bool(CLAUSE_ENDS.search(piece)))
        return out


def term_forms(word: str) -> list[str]:
    """A word and its beginnings, so that inflected forms of a learned stem are known too."""
    return [word] + [f"{word[:k]}*" for k in STEMS if len(word) >= k]


def clause_scores(text: str | None, reader: Reader) -> tuple[list[tuple[float, int, int]], int]:
    """([(path weight, direct emissions, deflected emissions)] of each clause that emits something, number of clauses)."""
    found: list[tuple[float, int, int]] = []
    read = list(map(reader.__getitem__, text.split())) if text else []
    count = sum(r[2] for r in read) + bool(read and not read[-1][2])
    if not any(r[1] > 0 for r in read):
        return found, count
    state, weight, direct, deflected = START, 0.0, 0, 0
    for symbol, w, ends in [*read, (OTHER, 0.0, True)]:
        state, out = GRAMMAR[state, symbol]
        kind = out - 10 if out >= 10 else PLAIN if out == INSULT else -1
        if kind >= NEGATED:
            deflected += 1
        elif kind >= 0:
            direct += 1
            weight += ARC[kind] * (w or THREAT_WEIGHT)
        if ends:
            if direct or deflected:
                found.append((weight, direct, deflected))
            state, weight, direct, deflected = START, 0.0, 0, 0
    return found, count


#: Features of a text, all of its clauses: direct ones, their path weights, the heaviest path, direct ones with several emissions, all clauses,
#: deflected ones.
FEATURES = 6


def features(text: str | None, reader: Reader) -> list[float]:
    """What the clauses of a text score."""
    found, count = clause_scores(text, reader)
    hits = [c for c in found if c[1]]
    total = sum(min(c[0], 10.0) for c in hits)
    numbers = len(hits), total, max((c[0] for c in hits), default=0.0), sum(c[1] > 1 for c in hits), count, len(found) - len(hits)
    return [math.log1p(x) for x in numbers]


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def newton(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Weights and bias of an L2-penalised logistic model, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """The weights, where direct clauses never lower a score and deflected ones never raise it: weights of the wrong sign are left out."""
    free, signs = list(range(FEATURES)), [1, 1, 1, 1, 0, -1]
    while True:
        w = newton(x[:, free], y, penalty)
        wrong = [k for i, k in enumerate(free) if signs[k] * w[i] < 0]
        if not wrong:
            out = np.zeros(FEATURES + 1)
            out[[*free, FEATURES]] = w
            return out
        free = [k for k in free if k not in wrong]


def learned_terms(labelled: DataFrame) -> dict[str, float]:
    """Terms far likelier in toxic texts, with their log odds; labelled: text, toxic, a bounded sample.

    A term counts up to MOST_TIMES a text, against the words of all texts of a label, so what a long clean text holds once weighs little.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            times, docs = (Counter(), Counter()), (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = Counter(WORD.findall((t or "").replace("'", "").lower()))
                forms = Counter()
                for w, n in words.items():
                    for f in term_forms(w):
                        forms[f] += n
                times[bool(y)].update({f: min(n, MOST_TIMES) for f, n in forms.items()})
                times[bool(y)][""] += words.total()
                docs[bool(y)].update(forms.keys())
            names = list(times[0].keys() | times[1].keys())
            columns = [[c[t] for t in names] for c in (times[1], times[0], docs[1])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=["term", "pos", "neg", "texts"])

    counts = labelled.select("text", "toxic").mapInArrow(count, "term string, pos long, neg long, texts long")
    counts = materialise(counts.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("texts").alias("texts")), "toxic-terms")
    words = counts.where("term = ''").first()
    toxic = labelled.where("toxic = 1").count()
    if not words or not words["pos"] or not words["neg"]:
        return {}
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(p / words["pos"]) - F.log(q / words["neg"])
    spread = F.sqrt(1 / F.col("texts") + 1 / q)
    terms = counts.where(F.col("texts") >= max(LEAST_DOCS, LEAST_SHARE * toxic)).where("term <> ''").select("term", (odds - spread).alias("w")).where(F.col("w") >= LEAST_ODDS)
    return {r["term"]: float(r["w"]) for r in terms.orderBy(F.desc("w"), "term").limit(MOST_TERMS).collect()}


def measured(rows: DataFrame, lexicon: dict[str, float], weights: np.ndarray | None, *keep: str) -> DataFrame:
    """Columns `keep` with the features of each text, or with its score where weights are given."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicon, weights))
    rows = rows.select(*keep, "text")
    column = "features array<double>" if weights is None else "score double"

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        lexicon, weights = shared.value
        reader = Reader(lexicon)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for part in text_batches(texts):
                x = [features(t, reader) for t in texts[part]]
                out = pa.array(x, pa.list_(pa.float64())) if weights is None else pa.array(Model(lexicon, weights).score(np.array(x, float).reshape(len(x), FEATURES)))
                here = b.slice(part.start, len(x))
                yield pa.RecordBatch.from_arrays([*here.columns[:-1], out], names=[*keep, column.split()[0]])

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [column])
    return rows.mapInArrow(each, schema)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), from folds 1 to 4 of 5 and a bounded sample of them.

    Terms are learned from folds 1 and 2, the weights of what clauses emit from folds 3 and 4, so neither flatters the other. Null ids
    and null labels teach nothing; of repeated ids the highest label and the last text in order count; without labels of both kinds the
    weights are fixed ones.
    """
    marks = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, SAMPLE_DOCS / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    # At most SAMPLE_DOCS labels, about: a bounded broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    # One row an id, so that the bound on labels is one on rows.
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic"))
    lexicon = learned_terms(rows.where(fold(F.col("doc_id"), 5).isin(1, 2)))
    seen = measured(rows.where(fold(F.col("doc_id"), 5).isin(3, 4)), lexicon, None, "toxic").toPandas()
    x = np.array(seen["features"].tolist(), float).reshape(len(seen), FEATURES)
    y = seen["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, np.array([1.0, 2.0, 0.0, 0.0, -0.5, 0.0, -2.0]))
    return Model(lexicon, logistic(x, y))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; fold 0 of 5 is never learned from.

    Null and empty texts score as texts without a match; rows with a null id are scored and not held out; repeated rows stay; of
    repeated labels the highest counts; other columns are ignored. Without labels of both kinds fixed weights are used.
    """
    model = fit(docs, labels)
    out = measured(docs, model.lexicon, model.weights, "doc_id")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, whole and with all their columns, that score below `least`.

    Null and empty texts score as texts without a match and stay; rows with null ids and repeated rows are scored as all others are; an
    empty table gives no rows; without labels of both kinds fixed weights are used. Only texts go to Python.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own_worker("toxicity")
        model = shared.value
        reader = Reader(model.lexicon)
        for t in texts:
            yield pd.Series(model.score(np.array([features(x, reader) for x in t], float).reshape(len(t), FEATURES)))

    return docs.where(score(F.col("text")) < least)
