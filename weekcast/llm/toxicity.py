"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols: insult, threat, target, negation, report, other, clause end. Three transducers,
one each for negation, reported speech and target, are composed into one machine that runs over a clause and
emits patterns: a plain, targeted, answered, negated or reported insult or threat. A document's score is a
logistic function of its patterns' weights, each match weighted by its lexeme.

The insult lexicon (whole words, and word beginnings marked with *) is learnt from labelled rows by greedy
cover: the lexeme that explains most toxic documents not yet explained comes next. A lexeme marked with + is
evidence only in documents that it matches at least twice (++ three times, +++ four), and is judged by those:
clean documents hold some stems of insults once or, if they are long, twice. Copies of one toxic
document are explained by their insult, so the other words they share never enter the lexicon.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import slices, stored

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
#: Labelled rows that the lexicon and the weights are fitted on, at most; taken in the order of a hash of their id.
FIT_ROWS = 20_000
#: Letters of the word beginnings that are learnt; the upper bound is for "words" without an end.
SHORTEST, LONGEST = 3, 32
#: Marks of lexemes that have to match a document's words again, by how often.
AGAIN = {"+": 2, "++": 3, "+++": 4}
#: Share of toxic among the documents that a lexeme may occur in.
PRECISION = 0.95
PREDICT_AT = 0.3

THREATS = ("kill", "hurt", "destroy", "murder", "töten", "umbringen", "vernichten", "tuer", "détruire", "matar", "destruir")
TARGETS = ("you", "your", "yours", "u", "du", "dich", "dein", "ihr", "euch", "tu", "toi", "vous", "votre", "te", "tú", "usted", "ustedes", "vosotros")
NEGATIONS = ("not", "never", "no", "nobody", "isn", "aren", "nicht", "nie", "kein", "keine", "pas", "jamais", "aucun", "nunca", "ningún", "jamás")
REPORTS = ("said", "says", "wrote", "writes", "called", "calls", "quoted", "claimed", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó")

SYMBOLS = "OIHYNR."
#: Emitted patterns and the weights that the fit starts from.
PRIOR = {"I": 2.0, "J": 3.0, "A": 1.0, "i": 0.5, "q": 0.5, "H": 1.0, "G": 3.0, "h": 0.2, "p": 0.2}
PATTERNS = "".join(PRIOR)
PRIOR_BIAS = -3.0


@dataclass
class Transducer:
    """Deterministic: (state, symbol) to (state, emitted symbol); symbols without an arc pass through."""

    arcs: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def then(self, other: "Transducer", symbols: str) -> "Transducer":
        """The composition: `other` reads what this one emits. States are numbered as they are reached."""
        number, queue, arcs = {(0, 0): 0}, [(0, 0)], {}
        while queue:
            a, b = pair = queue.pop()
            for symbol in symbols:
                x, middle = self.step(a, symbol)
                y, out = other.step(b, middle)
                if (x, y) not in number:
                    number[x, y] = len(number)
                    queue.append((x, y))
                arcs[number[pair], symbol] = (number[x, y], out)
        return Transducer(arcs)


def negation(reach: int = 3) -> Transducer:
    """An insult or threat up to `reach` symbols behind a negation is negated."""
    arcs = {}
    for state in range(reach + 1):
        arcs[state, "N"] = (reach, "N")
        arcs[state, "."] = (0, ".")
        for symbol in "OYR":
            arcs[state, symbol] = (max(0, state - 1), symbol)
        for symbol in "IH":
            arcs[state, symbol] = (max(0, state - 1), symbol.lower() if state else symbol)
    return Transducer(arcs)


def reported() -> Transducer:
    """What follows a verb of saying within the clause is reported."""
    arcs = {(0, "R"): (1, "R"), (1, "."): (0, ".")}
    for symbol, out in zip("IiHh", "qqpp"):
        arcs[1, symbol] = (1, out)
    return Transducer(arcs)


def target() -> Transducer:
    """An insult or threat behind a target is targeted; a target behind an insult makes it answered."""
    return Transducer({(0, "Y"): (1, "O"), (0, "I"): (2, "I"), (2, "Y"): (1, "A"), (1, "I"): (1, "J"), (1, "H"): (1, "G"), (1, "."): (0, "."), (2, "."): (0, "."), (1, "Y"): (1, "O")})


def grammar() -> Transducer:
    return negation().then(reported(), SYMBOLS).then(target(), SYMBOLS)


def begins(word: str, shortest: int = 4) -> list[str]:
    """A word and its beginnings, as lexemes."""
    return [word] + [word[:n] + "*" for n in range(shortest, min(len(word), LONGEST + 1))]


def matches(code: np.ndarray, lexemes: list[list[str]]) -> Counter:
    """How many words of a document each lexeme matches."""
    out: Counter = Counter()
    for c, n in Counter(code.tolist()).items():
        for x in lexemes[c]:
            out[x] += n
    return out


def holding(found: Counter) -> set[str]:
    """The lexemes that are evidence in a document, by themselves or (+) by matching again."""
    return set(found) | {x + mark for x, n in found.items() for mark, least in AGAIN.items() if n >= least}


class Lexicon:
    """Symbols and insult weights of words."""

    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.fixed = {w: s for s, ws in (("H", THREATS), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in ws} | {c: "." for c in ".!?;\n"}

    def read(self, word: str) -> tuple[str, float]:
        hits = [self.insults[x] for x in begins(word, SHORTEST) if x in self.insults]
        if hits:
            return "I", max(hits)
        symbol = self.fixed.get(word, "O")
        return symbol, 1.0 if symbol == "H" else 0.0

    def again(self, word: str) -> list[str]:
        """Lexemes of a word that count where they match a document's words again."""
        return [x + mark for x in begins(word, SHORTEST) for mark in AGAIN if x + mark in self.insults]


def repeated(lexicon: Lexicon, words: list[str], code: np.ndarray, rows: np.ndarray, symbol: np.ndarray, weight: np.ndarray) -> None:
    """Makes insults of the tokens whose lexeme matches their row as often as its mark says."""
    again = [lexicon.again(w) for w in words]
    names = sorted({x for xs in again for x in xs})
    at = [np.flatnonzero(np.array([x in xs for xs in again])[code]) for x in names]
    for x, own in zip(names, at):
        _, where, many = np.unique(rows[own], return_inverse=True, return_counts=True)
        own = own[many[where] > x.count("+")]
        own = own[(symbol[own] == 0) | (symbol[own] == 1)]
        symbol[own] = 1
        weight[own] = np.maximum(weight[own], lexicon.insults[x])


def tokens_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    """(row bounds, word number of each token, distinct words, ids of rows) of a batch."""
    split = [TOKEN.findall(t.lower()) for t in part.column("text").fill_null("").to_pylist()]
    code, words = pd.factorize(np.array([w for s in split for w in s], dtype=object))
    return np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64), code, list(words), split


def pattern_sums(part: pa.RecordBatch, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    """Weighted counts of the patterns of each row, each at most 3."""
    bounds, code, words, _ = tokens_of(part)
    out = np.zeros((len(bounds) - 1, len(PATTERNS)))
    if not words:
        return out
    read = [lexicon.read(w) for w in words]
    symbol, weight = np.array([SYMBOLS.index(s) for s, _ in read], np.uint8)[code], np.array([w for _, w in read])[code]
    repeated(lexicon, words, code, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), symbol, weight)
    hits = np.flatnonzero((symbol == 1) | (symbol == 2))
    ends = np.flatnonzero(symbol == 6)
    rows = np.searchsorted(bounds, hits, "right") - 1
    done = -1
    for row, hit in zip(rows.tolist(), hits.tolist()):
        if hit < done:
            continue  # in a clause that has been read
        k = np.searchsorted(ends, hit)
        start = max(bounds[row], ends[k - 1] + 1 if k else 0)
        done = int(min(bounds[row + 1], ends[k] if k < len(ends) else len(symbol)))
        state = 0
        for at in range(int(start), done):
            state, emitted = machine.step(state, SYMBOLS[symbol[at]])
            if emitted in PRIOR:
                out[row, PATTERNS.index(emitted)] += weight[at] if symbol[at] in (1, 2) else 1.0
    return np.minimum(out, 3.0)


def fit_weights(sums: np.ndarray, toxic: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic weights, the bias last, held towards the prior by `pull`; Newton's method."""
    x = np.hstack([sums, np.ones((len(sums), 1))])
    prior = np.array([*PRIOR.values(), PRIOR_BIAS])
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        grad = x.T @ (p - toxic) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), grad)
        w -= step.clip(-2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def cover(found: list[set[str]], weight: dict[str, float], support: int) -> list[str]:
    """Lexemes in the order in which they explain most rows not yet explained, while they explain `support`."""
    rows_of: dict[str, list[int]] = {}
    for row, lexemes in enumerate(found):
        for x in lexemes:
            rows_of.setdefault(x, []).append(row)
    gain = {x: len(rows) for x, rows in rows_of.items()}
    explained, chosen = np.zeros(len(found), bool), []
    while gain:
        # on equal gain the stronger, then whole words before beginnings, then longer ones
        best = max(gain, key=lambda x: (gain[x], weight[x], x[-1] not in "*+", len(x), x))
        if gain[best] < support:
            break
        chosen.append(best)
        for row in rows_of[best]:
            if not explained[row]:
                explained[row] = True
                for x in found[row] & gain.keys():
                    gain[x] -= 1
        del gain[best]
        gain = {x: n for x, n in gain.items() if n >= support}
    return chosen


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Lexicon and weights from at most `fit_rows` labelled rows; `labels` must hold training rows only."""
    once = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # a hash threshold first, so that the sort sees little more than the rows it keeps
    share = min(1.0, 1.25 * fit_rows / max(1, once.count()))
    near = once.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    some = near.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(fit_rows)
    # one row for each id, however many repeat it: the smallest text
    sample = stored(docs.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "sample")
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    support = 3 if toxic >= 200 else 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [Counter(), Counter()]
        for part in slices(batches, "text"):
            bounds, code, words, _ = tokens_of(part)
            lexemes = [begins(w, SHORTEST) if len(w) > 3 else [] for w in words]
            for a, b, label in zip(bounds[:-1], bounds[1:], part.column("toxic").to_pylist()):
                sides[int(label == 1)].update(holding(matches(code[a:b], lexemes)))
        names = sorted(set(sides[1]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sides[1][x] for x in names], pa.int64()), pa.array([sides[0][x] for x in names], pa.int64())], ["lexeme", "toxic", "clean"])
        rest = sorted(set(sides[0]) - set(names))
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([sides[0][x] for x in rest], pa.int64())], ["lexeme", "toxic", "clean"])

    counted = sample.mapInArrow(count, "lexeme string, toxic long, clean long").groupBy("lexeme").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sharp = counted.where((F.col("toxic") >= support) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    top = sharp.orderBy(F.desc("toxic"), "clean", "lexeme").collect()  # words of at most fit_rows texts
    weight = {r.lexeme: float(np.log((r.toxic + 0.5) / (toxic + 1)) - np.log((r.clean + 0.5) / (clean + 1))) for r in top}

    useful = {x.rstrip("+") for x in weight}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bounds, code, words, _ = tokens_of(part)
            lexemes = [[x for x in begins(w, SHORTEST) if x in useful] for w in words]
            found = [sorted(holding(matches(code[a:b], lexemes)) & weight.keys()) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["found"])

    found = [set(r.found) for r in sample.where("toxic = 1").mapInArrow(incidence, "found array<string>").collect()]
    chosen = cover(found, weight, support)
    scale = float(np.median([weight[x] for x in chosen])) if chosen else 1.0
    lexicon = Lexicon({x: weight[x] / scale for x in chosen})
    machine = grammar()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(pattern_sums(part, lexicon, machine).tolist(), pa.list_(pa.float64())), part.column("toxic")], ["sums", "toxic"])

    # at most fit_rows short rows; in one order, whatever the tasks' order
    rows = sorted(sample.mapInArrow(sums, "sums array<double>, toxic int").collect())
    return Model(lexicon, fit_weights(np.array([r.sums for r in rows]).reshape(-1, len(PATTERNS)), np.array([r.toxic for r in rows], float)))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", is_training=None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score, predicted) of every row of `docs`.

    `labels` holds (id, toxic); `is_training` is a condition on `doc_id` that says which rows may be learnt
    from (default: all). A label given twice counts as toxic if either says so; null labels and ids are left
    out; without any label there are no insults, and the prior weights score threats. Null and empty texts match no clause
    and get the score of the bias. Rows that repeat an id are scored each for itself. Empty input gives no
    rows; other columns are not read, so no label, language, source or id enters a score.
    """
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    known = labels.select(F.col(id_column).alias("doc_id"), "toxic")
    model = fit(own, known if is_training is None else known.where(is_training), fit_rows)
    machine = grammar()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            logit = pattern_sums(part, model.lexicon, machine) @ model.weights[:-1] + model.weights[-1]
            score = 1 / (1 + np.exp(-logit.clip(-30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double, predicted int")

