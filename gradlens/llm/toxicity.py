"""Toxicity by a weighted finite-state pattern grammar.

A clause is a sequence of words. A cascade of weighted transducers is composed over it: the lexicon (letters of a word to
its class; insults with a learned weight), targets (an insult soon after an address), negation (an insult or a threat soon
after a negation), reported speech (the same after a verb of saying), threats (a target soon after a threat verb) and the
frame (a clause has at least two words). Arcs carry weights, and composition multiplies them: what comes out for a match
is the insult's weight times the prior weights of its contexts, in the order reported < negated < plain < aimed < menace.
A document's score is a logistic function, with a positive slope, of the sum over its matched clauses; the lexicon, the
slope and the bias are fitted on a bounded sample of labelled rows. A word that stands alone makes no clause and scores
nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.llm._common import freed, table
from gradlens.llm.language import fold

# Closed word classes in English, German, French and Spanish (fixed values).
TARGETS = frozenset("you your yours you're he she they them him her du dich dir ihr euch sie er ihnen tu toi te vous il elle ils elles ti usted ustedes vosotros él ella ellos ellas".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't nicht kein keine keinen nie niemals pas jamais aucun nunca jamás tampoco ningún ninguna".split())
REPORTS = frozenset("said says wrote claimed reported quoted called sagte sagt schrieb behauptete meinte dit disait écrit affirme dijo dice escribió afirmó".split())
THREATS = frozenset("kill hurt destroy beat stab shoot töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())

#: Classes of words, and the match that a threat and its target make.
OTHER, INSULT, TARGET, NEGATION, REPORT, THREAT, MENACE = range(7)
CLASSES = 6
#: Contexts as bits above the classes.
AIMED, NEGATED, REPORTED = 8, 16, 32
#: Prior weights of the contexts (a plain match: 1). Every product of them keeps reported < negated < plain < aimed < menace.
WEIGHTS = {REPORTED: 0.1, NEGATED: 0.3, AIMED: 2.0, MENACE: 3.0}
#: Words over which a negation, an address or a threat reaches.
REACH = 3
#: Weight of a threat where the lexicon has no insult; else the largest one's.
THREAT_WEIGHT = 4.0
#: The fitted slope is at least this, so that a heavier match never scores less.
LEAST_SLOPE = 0.5

#: Labelled rows that the lexicon and the logistic weights are fitted on, at most.
FIT_ROWS = 12_000
#: Entries of the lexicon, at most; by weight.
LEXICON = 20_000
#: Words with less weight are no insults.
LEAST_WEIGHT = 2.25
PREFIXES = (4, 5, 6)

#: Words that a task remembers.
REMEMBER = 50_000
_PLAIN_WORD = OTHER, 1.0
_TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.,;:!?\n|]").findall
_MARKS = frozenset(".,;:!?\n|")


@dataclass
class Fst:
    """A deterministic weighted transducer over small integers: (state, symbol) -> (state, symbol, weight); state 0 starts.

    A symbol without an arc passes as it is, with weight 1. final: weights of the states at a clause's end (else 1).
    """

    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)
    final: dict[int, float] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def compose(first: Fst, second: Fst, inputs: int = CLASSES) -> Fst:
    """first's output goes into second, weights multiply; only pairs of states that can be reached become states."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        pair = todo.pop()
        for x in range(inputs):
            a, mid, v = first.step(pair[0], x)
            b, out, w = second.step(pair[1], mid)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[pair], x] = number[a, b], out, v * w
    return Fst(arcs, {n: first.final.get(a, 1.0) * second.final.get(b, 1.0) for (a, b), n in number.items()})


def _context(trigger: int, bit: int, on: tuple[int, ...], reach: int | None) -> Fst:
    """Marks and weighs symbols of the classes `on` for `reach` words after `trigger` (None: to the clause's end)."""
    states = 2 if reach is None else reach + 1
    arcs = {}
    for s in range(states):
        for x in range(64):
            if x & 7 == trigger:
                arcs[s, x] = states - 1, x, 1.0
            else:
                left = s if reach is None else max(0, s - 1)
                arcs[s, x] = (left, x | bit, WEIGHTS[bit]) if s and x & 7 in on else (left, x, 1.0)
    return Fst(arcs)


def _threats() -> Fst:
    """A target within REACH words of a threat becomes a MENACE, with the threat's contexts and their weights."""
    arcs, marks = {}, (0, NEGATED, REPORTED, NEGATED | REPORTED)
    state = lambda left, mark: 1 + (left - 1) * len(marks) + marks.index(mark) if left else 0
    for left in range(REACH + 1):
        for mark in marks if left else (0,):
            for x in range(64):
                if x & 7 == THREAT:
                    arcs[state(left, mark), x] = state(REACH, x & (NEGATED | REPORTED)), x, 1.0
                elif x & 7 == TARGET and left:
                    weight = math.prod([WEIGHTS[MENACE], *(WEIGHTS[b] for b in (NEGATED, REPORTED) if mark & b)])
                    arcs[state(left, mark), x] = 0, MENACE | mark, weight
                else:
                    arcs[state(left, mark), x] = state(left - 1, mark) if left else 0, x, 1.0
    return Fst(arcs)


def _frame() -> Fst:
    """Accepts clauses of two words or more."""
    return Fst({(s, x): (min(s + 1, 2), x, 1.0) for s in range(3) for x in range(64)}, {0: 0.0, 1: 0.0, 2: 1.0})


@lru_cache(maxsize=1)
def grammar() -> Fst:
    """The composed grammar over word classes. Its outputs carry a match's contexts, its arcs their weights."""
    out = _context(TARGET, AIMED, (INSULT,), REACH)
    for part in (_context(NEGATION, NEGATED, (INSULT, THREAT), REACH), _context(REPORT, REPORTED, (INSULT, THREAT), None), _threats(), _frame()):
        out = compose(out, part)
    return out


def flat() -> Fst:
    """No grammar: every insult counts alike. For comparison only."""
    return Fst()


class Lexicon:
    """The lexicon as a transducer from letters to (class, weight): a trie; `beginning*` accepts every longer word."""

    def __init__(self, insults: dict[str, float]) -> None:
        self.arcs: dict[tuple[int, str], int] = {}
        self.whole: dict[int, tuple[int, float]] = {}
        self.begun: dict[int, float] = {}
        for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            for w in words:
                self.whole[self._state(w)] = kind, 1.0
        for w, weight in insults.items():
            if w.endswith("*"):
                self.begun[self._state(w[:-1])] = weight
            else:
                self.whole[self._state(w)] = INSULT, weight

    def _state(self, letters: str) -> int:
        state = 0
        for c in letters:
            state = self.arcs.setdefault((state, c), len(self.arcs) + 1)
        return state

    def read(self, word: str) -> tuple[int, float]:
        state, best = 0, 0.0
        for c in word:
            best = max(best, self.begun.get(state, 0.0))
            state = self.arcs.get((state, c), -1)
            if state < 0:
                break
        kind, weight = self.whole.get(state, _PLAIN_WORD)
        if best and (kind != INSULT or best > weight):
            return INSULT, best
        return self.whole.get(state, _PLAIN_WORD)


class Matcher(dict):
    """Reads documents through lexicon and grammar, composed as it reads; as a dict it remembers each word's class and weight."""

    def __init__(self, insults: dict[str, float], fst: Fst | None = None) -> None:
        super().__init__(dict.fromkeys(_MARKS))
        self.lexicon, self.fst = Lexicon(insults), fst or grammar()
        self.menace = max(insults.values(), default=THREAT_WEIGHT)

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > REMEMBER:
            self.clear()
            self.update(dict.fromkeys(_MARKS))
        self[word] = self.lexicon.read(word)
        return self[word]

    def clauses(self, text: str) -> Iterator[list[tuple[int, float]]]:
        """Matches (symbol, weight) of each clause that the grammar accepts and that has any."""
        clause: list[tuple[int, float]] = []
        live = False
        for x in [*map(self.__getitem__, _TOKENS(text.lower())), None]:
            if x is not None:
                clause.append(x)
                live = live or x[0] == INSULT or x[0] == THREAT
                continue
            if live:
                state, found = 0, []
                for kind, weight in clause:
                    state, out, w = self.fst.step(state, kind)
                    if out & 7 == INSULT:
                        found.append((out, w * weight))
                    elif out & 7 == MENACE:
                        found.append((out, w * self.menace))
                end = self.fst.final.get(state, 1.0)
                if found and end:
                    yield [(out, w * end) for out, w in found]
            clause, live = [], False

    def features(self, text: str) -> tuple[float, int]:
        """Sum of the matches' weights, damped by log1p, and the number of matched clauses."""
        total, n = 0.0, 0
        for found in self.clauses(text):
            n += 1
            total += sum(w for _, w in found)
        return math.log1p(total), n


def asserted(text: str) -> set[str]:
    """Words of the clauses without a negation or a verb of saying."""
    out: set[str] = set()
    clause: list[str] = []
    for w in [*_TOKENS(text.lower()), "."]:
        if w not in _MARKS:
            clause.append(w)
            continue
        if NEGATIONS.isdisjoint(clause) and REPORTS.isdisjoint(clause):
            out.update(x for x in clause if len(x) > 1)
        clause = []
    return out


@dataclass(frozen=True)
class Model:
    insults: dict[str, float]
    slope: float
    bias: float
    #: False: every insult counts alike, whatever its clause (for comparison only).
    contexts: bool = True

    def matcher(self) -> Matcher:
        return Matcher(self.insults, None if self.contexts else flat())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope (LEAST_SLOPE at least) and bias of a ridge logistic regression on one feature, by Newton's method."""

    def newton(columns: np.ndarray, offset: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        w = np.zeros(columns.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(columns @ w + offset, -30, 30)))
            h = (columns * (p * (1 - p))[:, None]).T @ columns + np.diag(penalty + 1e-9)
            step = np.linalg.solve(h, columns.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        return w

    one = np.ones(len(x))
    slope, bias = newton(np.column_stack([x, one]), 0 * one, np.array([ridge, 1e-3]))
    if slope < LEAST_SLOPE:
        slope, bias = LEAST_SLOPE, newton(one[:, None], LEAST_SLOPE * x, np.array([1e-3]))[0]
    return float(slope), float(bias)


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Texts and labels (text, y) of at most `rows` labelled documents: those whose ids hash lowest; half of each label at most."""
    known = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).filter("k is not null and y in (0, 1)")
    few = [known.filter(F.col("y") == v).orderBy(F.xxhash64("k"), "k").limit(rows // 2) for v in (0, 1)]
    chosen = few[0].union(few[1])  # at most `rows` rows of two numbers: safe to broadcast
    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "k").select("text", "y").filter("text is not null")


def _weight(n0: int, n1: int, d0: int, d1: int) -> float:
    """Log of the ratio of the rates among toxic and other texts, less two standard errors; 0 if that is no insult.

    Few occurrences, as in families of near copies, are little evidence.
    """
    if n1 < max(4, 0.004 * d1):
        return 0.0
    weight = math.log((n1 + 0.5) / (d1 + 1)) - math.log((n0 + 0.5) / (d0 + 1)) - 2 * math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    return weight if weight >= LEAST_WEIGHT else 0.0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, contexts: bool = True, **names: str) -> Model:
    """Learns the insults (words, and beginnings of words) with their weights, and slope and bias of the score.

    Counts of words by label are taken over distinct texts, so copies don't count twice; a text whose rows differ in
    label has the usual one (a tie: toxic), whatever the order of rows. Words in negated or reporting clauses say nothing
    about a label. No toxic rows: an empty lexicon, so only threats score above the share of toxic rows; no
    labels at all: 0.5 for all.
    """
    train = sample(docs, labels, rows, **names).groupBy("text").agg((F.avg("y") >= 0.5).cast("int").alias("y")).persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        docs_of = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = asserted(text)
                n[y].update(words | {f"{w[:k]}*" for w in words for k in PREFIXES if len(w) > k})
                docs_of[y] += 1
        every = list(set(n[0]) | set(n[1]))
        yield pa.record_batch([pa.array(["", *every]), pa.array([docs_of[0], *(n[0][w] for w in every)], pa.int64()), pa.array([docs_of[1], *(n[1][w] for w in every)], pa.int64())], names=["w", "n0", "n1"])

    counts = train.mapInArrow(freed(count), "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = {r["w"]: (r["n0"], r["n1"]) for r in counts.filter("w = '' or (n1 >= 4 and n1 >= 8 * n0)").orderBy(F.desc("n1"), "w").limit(LEXICON).collect()}
    d0, d1 = found.pop("", (0, 0))
    lexicon = {w: x for w, (n0, n1) in found.items() if not w.endswith("*") and (x := _weight(n0, n1, d0, d1))}
    for w, (n0, n1) in found.items():
        if w.endswith("*"):  # what a beginning says beyond the whole words that have it
            own = [found[x] for x in lexicon if not x.endswith("*") and len(x) >= len(w) and x.startswith(w[:-1])]
            n0, n1 = max(0, n0 - sum(x[0] for x in own)), n1 - sum(x[1] for x in own)
            if n1 >= 8 * n0 and (x := _weight(n0, n1, d0, d1)):
                lexicon[w] = x
    matcher = Model(lexicon, 1.0, 0.0, contexts).matcher()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [matcher.features(t)[0] for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.float64()), batch.column(1)], names=["x", "y"])

    got = sorted(train.mapInArrow(freed(look), "x double, y int").collect())  # at most `rows` rows of two numbers; in order, so sums repeat
    train.unpersist()
    if not got:
        return Model({}, 0.0, 0.0, contexts)
    return Model(lexicon, *_logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)), contexts)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_clauses. Null and empty texts score like any text without a match. Repeated rows and null ids give a row each. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            found = [matcher.features(t or "") for t in batch.column(1).to_pylist()]
            x = np.array([f[0] for f in found], float)
            p = 1 / (1 + np.exp(-np.clip(x * model.slope + model.bias, -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(p, pa.float64()), pa.array([f[1] for f in found], pa.int64())], names=["doc_id", "score", "n_clauses"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(freed(run), "doc_id long, score double, n_clauses long")


def op8_clause_grammar(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    out = score_toxicity(docs, fit(docs, train))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")
