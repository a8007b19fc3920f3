"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns each word into a symbol: insult or threat (with a weight), target, negation, report, or other.
Five transducers, each with its own states, rewrite the symbols of a clause one after the other and weigh them:

* negation: what follows within three words is weakened;
* report: what follows reported speech in the clause is weakened;
* target: an insult behind a target becomes an aimed one;
* insult: a target within three words behind an insult makes it an aimed one, too;
* threat: a target within three words behind a threat carries the threat out.

They are composed into one machine. What it gives out are matches of four patterns: a bare insult, an aimed
insult, a bare threat, a threat with its target. A clause adds the weights of its matches to their patterns;
a text's score is a logistic function of its four sums, so a pattern counts for what it says of the label.

Learned from labels: insults, as whole words or beginnings of words, and threats, with their log odds, from a
bounded sample of labelled texts; and the numbers of the logistic function, from the other half of that sample,
drawn to given ones where the labels say little. Few words are given from the start; what the labels say of
them goes before.

Cases: a null or empty text has no clause, hence the score of a text without matches; rows with a null id
are held out; repeated rows are scored each, and equal texts of a label teach once; labels that repeat an id
count as toxic if one of them does; without labels of both kinds the given words and numbers stand; other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, written

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, BREAK, AIMED, CALLED, THREATENED = SYMBOLS = range(10)
#: What a text is weighed by: sums over bare insults, aimed insults, bare threats and threats with their target.
PATTERNS = 4
#: Given words; their weight until labels say otherwise.
GIVEN_WEIGHT = 2.5
#: Labelled texts that must hold a given threat before its weight is learned.
KNOWN_TEXTS = 10
WORDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers worthless pathetic bastard idiotin dummkopf trottel abschaum crétin imbécile ordure imbécil estúpido estúpida basura",
    THREAT: "kill murder hurt destroy burn töten umbringen vernichten tuer détruire matar destruir",
    TARGET: "you your you're u he she they du dich dir dein ihr euch tu toi te vous tú usted ustedes ti",
    NEGATION: "not no never don't isn't aren't nicht kein keine nie ne pas jamais non nunca",
    REPORT: "said says wrote reported quoted claimed sagte schrieb zitierte dit écrit affirme dijo escribió según",
}
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)


@dataclass(frozen=True)
class Transducer:
    """start state and arcs (state, symbol) -> (state, symbol, factor). A missing arc stays and copies."""

    arcs: dict
    start: int = 0

    def step(self, state: int, symbol: int) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


#: Symbols that stand for a word which neither matches nor aims.
PASSED = (OTHER, REPORT, NEGATION)


def negation(reach: int = 3, factor: float = 0.25) -> Transducer:
    arcs = {(s, NEGATION): (reach, NEGATION, 1.0) for s in range(reach + 1)} | {(s, BREAK): (0, BREAK, 1.0) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, x, 1.0) for x in (OTHER, TARGET, REPORT)} | {(s, x): (s - 1, x, factor) for x in (INSULT, THREAT)}
    return Transducer(arcs)


def report(factor: float = 0.5) -> Transducer:
    return Transducer({(0, REPORT): (1, REPORT, 1.0), (1, BREAK): (0, BREAK, 1.0)} | {(1, x): (1, x, factor) for x in (INSULT, THREAT)})


def target() -> Transducer:
    """State 1: a target was met in the clause."""
    return Transducer({(0, TARGET): (1, TARGET, 1.0), (1, BREAK): (0, BREAK, 1.0), (1, INSULT): (1, AIMED, 1.0)})


def insult(reach: int = 3) -> Transducer:
    """State s > 0: a bare insult, behind which a target may come within s words."""
    arcs = {(s, INSULT): (reach, INSULT, 1.0) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, x, 1.0) for x in PASSED} | {(s, x): (0, x, 1.0) for x in (AIMED, THREAT, BREAK)} | {(s, TARGET): (0, CALLED, 1.0)}
    return Transducer(arcs)


def threat(reach: int = 3) -> Transducer:
    """State s > 0: a threat, behind which a target may come within s words. A target that an insult was called at serves no threat."""
    arcs = {(s, THREAT): (reach, THREAT, 1.0) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, x, 1.0) for x in PASSED} | {(s, x): (0, x, 1.0) for x in (INSULT, AIMED, CALLED, BREAK)} | {(s, TARGET): (0, THREATENED, 1.0)}
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that gives what second gives on first's output; factors multiply. Only reachable states are made."""
    number, todo, arcs = {(first.start, second.start): 0}, [(first.start, second.start)], {}
    while todo:
        here = todo.pop()
        for symbol in SYMBOLS:
            a, middle, f = first.step(here[0], symbol)
            b, out, g = second.step(here[1], middle)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[here], symbol] = (number[a, b], out, f * g)
    return Transducer(arcs)


def machines() -> list[Transducer]:
    return [negation(), report(), target(), insult(), threat()]


def grammar() -> Transducer:
    first, *rest = machines()
    for t in rest:
        first = compose(first, t)
    return first


#: The logistic function until labels say otherwise: what a text without matches has, and a factor for each pattern.
GIVEN_BIAS, GIVEN_FACTORS = -4.0, (2.0, 3.0, 0.6, 3.0)


@dataclass
class Lexicon:
    """Weights of whole words, of beginnings (by their length) and of threats, and the logistic function a + b . s."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(WORDS[THREAT].split(), GIVEN_WEIGHT))
    a: float = GIVEN_BIAS
    b: tuple[float, ...] = GIVEN_FACTORS

    def weight(self, word: str) -> float:
        """An insult's weight; 0 for a word that is none."""
        found = [self.words.get(word, 0.0)] + [self.beginnings.get(word[:k], 0.0) for k in BEGINNINGS if len(word) >= k]
        return max(found)


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.step = lexicon, grammar().step
        self.fixed = {w: kind for kind in (TARGET, NEGATION, REPORT) for w in WORDS[kind].split()}
        self.known: dict[str, tuple[int, float]] = {}

    def symbol(self, token: str) -> tuple[int, float]:
        """The symbol of a lower-case token, and its weight. A token that is not known whole is what the best of its parts at apostrophes is."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self._symbol(token)
            if got == (OTHER, 0.0) and not token.isalpha():
                got = max((self._symbol(x) for x in WORD.findall(token)), key=lambda x: x[1], default=got)
            self.known[token] = got
        return got

    def _symbol(self, word: str) -> tuple[int, float]:
        if word in self.fixed:
            return self.fixed[word], 0.0
        if word in self.lexicon.threats:
            return THREAT, self.lexicon.threats[word]
        weight = self.lexicon.weight(word)
        return (INSULT, weight) if weight > 0 else (OTHER, 0.0)

    def clauses(self, text: str) -> list[list[float]]:
        """The sums of the four patterns of each clause of a lower-case text that matches one."""
        step, symbol_of, out, state = self.step, self.symbol, [], 0
        sums, insulted, threatened = None, 0.0, 0.0
        for token in TOKEN.findall(text):
            if len(token) == 1 and not token.isalpha():
                state = step(state, BREAK)[0]
                if sums is not None:
                    out.append(sums)
                sums = None
                continue
            symbol, weight = symbol_of(token)
            state, match, factor = step(state, symbol)
            if match == OTHER:
                continue
            weight *= factor
            if match in (INSULT, THREAT, AIMED) and weight > 0:
                sums = sums or [0.0] * PATTERNS
                if match == INSULT:
                    sums[0] += weight
                    insulted = weight
                elif match == AIMED:
                    sums[1] += weight
                else:
                    sums[2] += weight
                    threatened = weight
            elif match == THREAT:  # one that counts for nothing
                threatened = 0.0
            elif match == CALLED:
                sums[0] -= insulted
                sums[1] += insulted
            elif match == THREATENED and threatened:
                sums[2] -= threatened
                sums[3] += threatened
        return [*out, sums] if sums is not None else out

    def sums(self, text: str | None) -> list[float]:
        """The text's sums over its clauses."""
        total = [0.0] * PATTERNS
        if text:
            low = text.lower()
            symbol = self.symbol
            if any(symbol(w)[1] > 0 for w in set(WORD.findall(low))):
                for clause in self.clauses(low):
                    for k, x in enumerate(clause):
                        total[k] += x
        return total

    def score(self, text: str | None) -> float:
        s = self.lexicon.a + sum(b * x for b, x in zip(self.lexicon.b, self.sums(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with and without the label for each word and beginning ("x*"), summed over a batch; "" counts the texts."""
    for batch in pieces(batches, 0):
        by = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            by[toxic].update(words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) >= k} | {""})
        terms = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([by[y][t] for t in terms], pa.int64()) for y in (1, 0)]], ["term", "p", "n"])


def _sums(lexicon: Lexicon):
    names = [f"s{k}" for k in range(PATTERNS)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in pieces(batches, 0):
            s = np.array([scorer.sums(t) for t in batch.column(0).to_pylist()]).reshape(-1, PATTERNS)
            s = np.minimum(np.round(s * 4) / 4, 40.0)
            yield pa.RecordBatch.from_arrays([*[pa.array(s[:, k]) for k in range(PATTERNS)], batch.column(1)], [*names, "toxic"])

    return make


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "toxic", sample: int = 6000, most_terms: int = 4000, evidence: float = 2.0) -> Lexicon:
    """The lexicon from labelled rows for which `allowed`, a condition on doc_id, holds.

    sample: at most so many ids of either label are read, the first by hash of id. most_terms: entries kept,
    those of most evidence first. evidence: an entry's log-likelihood ratio must exceed that of the best of as
    many random terms, 2 log(number of terms), by this. Half of the texts, by a hash of the text, give the
    terms, the others the logistic function.
    """
    known = labels.select("doc_id", F.col(label_col).alias("_y")).where(allowed & F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("_y").cast("int").alias("toxic"))
    first = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id")).limit(sample)
    # at most twice `sample` rows of two numbers: a bound that no input exceeds
    chosen = F.broadcast(first(1).unionByName(first(0)))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic", (F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("half"))
    texts = written(texts.dropDuplicates(["text", "toxic"]), "labelled-texts")
    lexicon = Lexicon({w: GIVEN_WEIGHT for w in WORDS[INSULT].split()})
    counted = texts.where("half").select("text", "toxic").mapInArrow(_terms, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    counted = written(counted, "terms")
    whole = counted.where("term = ''").first()
    if whole is None or not whole["p"] or not whole["n"]:
        return lexicon
    P, N = whole["p"], whole["n"]
    share = P / (P + N)
    gain = lambda o, e: F.when(F.col(o) > 0, F.col(o) * F.log(F.col(o) / e)).otherwise(0.0)
    both = F.col("p") + F.col("n")
    ratio = 2 * (gain("p", both * share) + gain("n", both * (1 - share)))
    given = F.col("term").isin([*lexicon.words, *lexicon.threats])
    odds = F.log((F.col("p") + 0.5) / P / ((F.col("n") + 0.5) / N))
    strong = counted.where(F.col("term") != "").select("term", odds.alias("odds"), ratio.alias("g"), given.alias("given"), both.alias("texts"))
    strong = strong.where((F.col("given")) | ((F.col("g") >= evidence + 2 * math.log(counted.count())) & (F.col("odds") >= 2.5)))
    for r in strong.orderBy(F.desc("given"), F.desc("g"), "term").limit(most_terms).collect():
        term, weight = r["term"], r["odds"]
        if term in lexicon.threats:
            if r["texts"] >= KNOWN_TEXTS:
                lexicon.threats[term] = max(weight, 0.0)
        elif term.endswith("*"):
            lexicon.beginnings[term[:-1]] = weight
        else:
            lexicon.words[term] = weight if weight >= 1.0 else 0.0
    sums = [f"s{k}" for k in range(PATTERNS)]
    schema = ", ".join(f"{c} double" for c in sums) + ", toxic int"
    seen = texts.where("NOT half").select("text", "toxic").mapInArrow(_sums(lexicon), schema).groupBy(*sums, "toxic").count().collect()
    lexicon.a, lexicon.b = logistic([(tuple(r[c] for c in sums), r["toxic"], r["count"]) for r in seen])
    return lexicon


def logistic(rows: list[tuple[tuple[float, ...], int, int]], ridge: float = 0.02) -> tuple[float, tuple[float, ...]]:
    """a and b of 1 / (1 + exp(-a - b . s)) for (s, label, count), by Newton's method with a small penalty on how far b is from what is given.

    The penalised loss is convex; a step that doesn't lower it is halved, so the steps can't run away where
    the labels are nearly apart and the curve is flat. No pattern speaks against the label: a factor is 0 at least.
    """
    s = np.array([r[0] for r in rows], float).reshape(len(rows), PATTERNS)
    y, n = (np.array([r[k] for r in rows], float) for k in (1, 2))
    if not len(s) or not 0 < (y * n).sum() < n.sum():
        return GIVEN_BIAS, GIVEN_FACTORS
    x = np.concatenate([np.ones((len(s), 1)), s], 1)
    penalty = np.diag([1e-3, *[ridge] * PATTERNS])
    given = np.array([0.0, *GIVEN_FACTORS])

    def loss(w: np.ndarray) -> float:
        return float((n * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + (w - given) @ penalty @ (w - given) / 2)

    w = given
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (n * (y - p)) - penalty @ (w - given)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(hessian, gradient)
        while abs(move).max() > 1e-9 and loss(w + move) >= now:
            move = move / 2
        if abs(move).max() <= 1e-9:
            break
        w = w + move
        now = loss(w)
    return float(w[0]), tuple(max(float(v), 0.0) for v in w[1:])


def _scored(lexicon: Lexicon):
    """A column's score: only texts go to Python and only numbers come back. Said to be nondeterministic, so that Spark asks each text once."""

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(lexicon)
        for column in columns:
            parts = pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])]), 0)
            yield pa.array([scorer.score(t) for part in parts for t in part.column(0).to_pylist()], pa.float64())

    return scored.asNondeterministic()


def score(docs: DataFrame, lexicon: Lexicon, held_out: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns `carry` for every row of docs (doc_id, text)."""
    also = [F.col(c).alias(f"_{k}") for k, c in enumerate(carry)]
    out = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(True)).alias("held_out"), _scored(lexicon)("text").alias("score"), *also)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(f"_{k}").alias(c) for k, c in enumerate(carry)])
