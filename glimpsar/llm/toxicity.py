"""Toxicity scores from a weighted finite-state pattern grammar.

Five small transducers read the classes of a clause's tokens: *insult* (alone, or aimed at somebody who has been named,
with or without "is"), *threat* (does a threat meet a target), *target* (is somebody addressed at all), *negation* (a negator
lowers what follows it closely) and *reported speech* (a verb of saying or an opening quotation mark lowers what is
quoted).  They are composed into one machine by the product construction; each arc scales the weight of the token it reads
and may mark it with a pattern, scales multiply under composition, and a weakening mark overrules the others.  A clause's
score is the sum of its scaled weights times the final scale of the state reached, so an isolated insult, a negated one
and one hurled at somebody score differently.

Weights of insults are log-odds learned from labelled documents, of words and of word beginnings (so
that inflected forms of one stem share evidence); those of threats are learned by stem.  A logistic layer turns a document's
clause scores, and what it has of each pattern, into a probability: how much a pattern counts is learned as well.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, col, extended, mapped, pieces, stored
from .words import shingles

#: At most this many labelled documents are learned from, chosen by a hash of their ids.
TRAIN_ROWS = 24_000
PREFIXES = range(4, 8)
_WORD = re.compile(r"[^\W\d_]{2,}")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]|[.!?;:\n]+")
_CACHE = 100_000

INSULT, THREAT, TARGET, COPULA, NEGATION, REPORT, QUOTE, OTHER = range(8)
#: What a token can be part of.
PATTERNS = ("plain insult", "aimed insult", "bare threat", "aimed threat", "weakened")
PLAIN, AIMED, BARE, AIMED_THREAT, WEAKENED = range(5)

#: Seed lists of the closed classes (English, German, French, Spanish).
THREATS = "kill hurt destroy beat burn shoot stab strangle crush murder töten umbringen schlagen tuer frapper matar golpear"
ENDINGS = "s es ed er ers ing en e et st t é ée és a an ar as o"
TARGETS = "you your yours u he she they him her them du dich dir euch ihr tu toi vous te usted ustedes tus"
COPULAS = "are is was were be re bist ist sind seid war es est êtes eres son"
NEGATORS = "not no never nobody cannot isn aren don doesn nicht kein keine nie jamais pas nunca jamás"
REPORTS = "said says say told called calls quoted wrote claimed sagte nannte dit disait dijo llamó"
#: What insults and threats weigh where there is nothing to learn from.
SEED_INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb"
SEED_WEIGHT = 3.0
#: Scale of an insult that meets nobody, and that of one that is said of somebody.
ALONE, SAID_OF = 0.6, 1.25


def threat_forms() -> dict[str, str]:
    """Threat words and their inflected forms, with the stem of each: kill, kills, killing; stabbing; strangled."""
    out = {}
    for stem in THREATS.split():
        for base in (stem, stem + stem[-1], stem.removesuffix("e"), stem.removesuffix("en"), stem.removesuffix("er"), stem.removesuffix("ar")):
            if len(base) > 2:
                for ending in ENDINGS.split():
                    out.setdefault(base + ending, stem)
    return out | {stem: stem for stem in THREATS.split()}


@dataclass(frozen=True)
class Transducer:
    """Arcs ``(state, class) -> (state, scale)`` or ``(state, scale, pattern)``; a class without an arc leads to ``rest[state]``.

    Scales below 1 weaken the weight of the token that is read, and ``final`` that of the whole clause.
    """

    arcs: dict
    rest: dict
    final: dict = field(default_factory=dict)

    def step(self, state, kind: int) -> tuple:
        found = self.arcs.get((state, kind))
        if found is None:
            return self.rest.get(state, state), 1.0, None
        return found if len(found) == 3 else (*found, None)


def mark(patterns) -> int | None:
    """The pattern of a token from what each part makes of it."""
    found = [p for p in patterns if p is not None]
    return None if not found else WEAKENED if WEAKENED in found else found[0]


def compose(*parts: Transducer) -> tuple[list[list[tuple[int, float, int | None]]], list[float]]:
    """The reachable product machine: a table by state and class, and final scales; state 0 starts."""
    start = (0,) * len(parts)
    number, todo, table = {start: 0}, [start], []
    while todo:
        state = todo.pop(0)
        row = []
        for kind in range(8):
            steps = [p.step(s, kind) for p, s in zip(parts, state, strict=True)]
            after = tuple(s for s, _, _ in steps)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], math.prod(w for _, w, _ in steps), mark(p for _, _, p in steps)))
        table.append(row)
    final = [math.prod(p.final.get(s, 1.0) for p, s in zip(parts, state, strict=True)) for state in number]
    return table, final


def parts() -> tuple[Transducer, ...]:
    """Insult, threat, target, negation and reported speech."""
    # States: nobody named, somebody named, somebody named and something said of them ("you are ...").
    insult = Transducer(
        {(s, TARGET): (1, 1.0) for s in range(3)}
        | {(1, COPULA): (2, 1.0), (0, INSULT): (0, ALONE, PLAIN), (1, INSULT): (1, 1.0, AIMED), (2, INSULT): (2, SAID_OF, AIMED)},
        {},
    )
    # A threat counts in full once a target has been named, and little before.
    threat = Transducer({(0, TARGET): (1, 1.0), (0, THREAT): (0, 0.2, BARE), (1, THREAT): (1, 1.0, AIMED_THREAT)}, {})
    # A clause that names somebody at any place counts more.
    target = Transducer({(0, TARGET): (1, 1.0)}, {}, {1: 1.25})
    # A negator weakens an insult or threat among the next three tokens.
    negation = Transducer(
        {(s, NEGATION): (1, 1.0) for s in range(4)}
        | {(s, k): (0, 0.4, WEAKENED) for s in (1, 2, 3) for k in (INSULT, THREAT)},
        {1: 2, 2: 3, 3: 0},
    )
    report = Transducer(
        {(0, REPORT): (1, 1.0), (0, QUOTE): (1, 1.0), (1, QUOTE): (0, 1.0)}
        | {(1, k): (1, 0.6, WEAKENED) for k in (INSULT, THREAT)},
        {},
    )
    return insult, threat, target, negation, report


def grammar() -> tuple[list[list[tuple[int, float, int | None]]], list[float]]:
    """All of them in one machine."""
    return compose(*parts())


@dataclass(frozen=True)
class Model:
    """Weights of words, of word beginnings and of threats by stem, and the logistic layer over a document's features."""

    words: dict
    prefixes: dict
    threats: dict = field(default_factory=dict)
    coef: tuple = (-3.0, 1.5, 0.8, *[0.0] * len(PATTERNS))

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n and (w := self.prefixes.get(word[:n], 0.0)) > found:
                found = w
        return found


class Clause(NamedTuple):
    """A matched clause: offsets in code points, its score, and the weights of each pattern in it."""

    start: int
    end: int
    score: float
    weights: tuple[float, ...]

    @property
    def pattern(self) -> str:
        return PATTERNS[max(range(len(PATTERNS)), key=lambda p: self.weights[p])]


class Scorer:
    """Scores texts with one model; remembers what words are (bounded)."""

    def __init__(self, model: Model):
        self.model, (self.table, self.final) = model, grammar()
        self.closed = {w: k for k, text in ((REPORT, REPORTS), (NEGATION, NEGATORS), (COPULA, COPULAS), (TARGET, TARGETS)) for w in text.split()}
        self.threats = {form: model.threats.get(stem, SEED_WEIGHT) for form, stem in threat_forms().items()}
        self.known: dict[str, tuple[int, float]] = {}
        self.plain: set[str] = set()  # words without weight that texts have shown

    def read(self, token: str) -> tuple[int, float]:
        """Class and weight of a lower-case word."""
        found = self.known.get(token)
        if found is None:
            if token in self.closed:
                found = self.closed[token], 0.0
            elif (weight := self.model.weight(token)) > 0:
                found = INSULT, weight
            elif token in self.threats:
                found = THREAT, self.threats[token]
            else:
                found = OTHER, 0.0
            if len(self.known) >= _CACHE:
                self.known.clear()
            self.known[token] = found
        return found

    def triggered(self, text: str) -> bool:
        """Whether any word of a text has weight; most have none, which is told from the words that are new."""
        new = set(_WORD.findall(text.lower())) - self.plain
        hits = {w for w in new if w not in self.closed and (self.model.weight(w) > 0 or self.threats.get(w, 0.0) > 0)}
        if len(self.plain) > _CACHE:
            self.plain.clear()
        self.plain |= new - hits
        return bool(hits)

    def clauses(self, text: str) -> list[Clause]:
        """Matched clauses of a text."""
        if not text or not self.triggered(text):
            return []
        out: list[Clause] = []
        state, total, first, last, weights = 0, 0.0, -1, 0, [0.0] * len(PATTERNS)

        def close() -> None:
            nonlocal state, total, first, weights
            if total > 0:
                out.append(Clause(first, last, total * self.final[state], tuple(weights)))
                weights = [0.0] * len(PATTERNS)
            state, total, first = 0, 0.0, -1

        for m in _TOKEN.finditer(text):
            token = m.group().lower()
            if token[0] in ".!?;:\n":
                close()
                continue
            kind, weight = (QUOTE, 0.0) if token in "\"“”«»„" else self.read(token)
            state, scale, pattern = self.table[state][kind]
            if weight > 0:
                total += weight * scale
                weights[pattern] += weight
            first, last = m.start() if first < 0 else first, m.end()
        close()
        return out

    def features(self, clauses: list[Clause]) -> tuple[float, ...]:
        """Scores in all and of the worst clause, and the weights met in each pattern."""
        each = [math.log1p(sum(c.weights[p] for c in clauses)) for p in range(len(PATTERNS))]
        return (math.log1p(sum(c.score for c in clauses)), max((c.score for c in clauses), default=0.0) / 4, *each)

    def score(self, clauses: list[Clause]) -> float:
        c = self.model.coef
        z = c[0] + sum(a * b for a, b in zip(c[1:], self.features(clauses), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str):
    """Whether a document is never learned from: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


_COUNTS = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
_LISTS = T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(_terms(text or ""))
        if len(seen) > 500_000:
            yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, schema=arrow_schema(_COUNTS))
            seen = Counter()
    if seen:
        yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, schema=arrow_schema(_COUNTS))


def _log_odds(pos: int, neg: int, n_pos: int, n_neg: int) -> tuple[float, float]:
    value = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
    return value, math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def _choose(lists: list[list[str]], pos: dict[str, int], neg: dict[str, int], n_neg: int, depth: int = 3) -> dict[str, float]:
    """Terms that explain toxic documents best, greedily, until each has ``depth`` of them.

    Words that merely come along in copies of one toxic text explain nothing that the stronger terms
    have left over, and so are not taken.
    """
    n_pos = len(lists)
    weight = {}
    for t, p in pos.items():
        value, spread = _log_odds(p, neg.get(t, 0), n_pos, n_neg)
        if value - spread > 1.5 and p > 3 * neg.get(t, 0) * n_pos / max(1, n_neg):
            weight[t] = value
    holders = defaultdict(list)
    for i, terms in enumerate(lists):
        for t in terms:
            if t in weight:
                holders[t].append(i)
    need = [depth] * n_pos
    least = max(3, n_pos // 400)
    chosen: dict[str, float] = {}
    # Among equals the longer one, which is the more particular.
    heap = [(-len(h) * weight[t], -len(t), t) for t, h in holders.items()]
    heapq.heapify(heap)
    while heap:
        _, _, t = heapq.heappop(heap)
        left = sum(1 for i in holders[t] if need[i] > 0)
        if left < least:
            continue
        if heap and -left * weight[t] > heap[0][0]:
            heapq.heappush(heap, (-left * weight[t], -len(t), t))
            continue
        chosen[t] = min(6.0, weight[t])
        for i in holders[t]:
            need[i] -= 1
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-regularised logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn a model from the labelled rows of ``docs`` that are not held out.

    ``labels`` has ``doc_id`` and ``toxic``; rows with a null in either teach nothing, and an id that
    is labelled twice counts as toxic if one of its labels says so.  At most ``rows`` documents are
    used.  Exact and near copies count once: documents that agree in their label and in the
    smallest hash of their three-word shingles are represented by the smallest id.  Without toxic or without clean examples the seed
    lexicon is returned.
    """
    seeds = Model({w: SEED_WEIGHT for w in SEED_INSULTS.split()}, {})
    known = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__y"))
        .where("__id is not null and __y in (0, 1)")
        .where(~held_out("__id"))
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows)
    )
    # The limit bounds this side, so the texts are not shuffled for it.
    sample = stored(
        docs.select(col(id_col).cast("long").alias("__id"), col(text_col).alias("text")).join(F.broadcast(known), "__id"),
        "toxicity-sample",
    )
    context = T.StructType([T.StructField("__id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("context", T.LongType())])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            values, bounds = shingles([(t or "").encode() for t in batch.column("text").to_pylist()], 3)
            low = [int(values[a:b].min()) - (1 << 63) if b > a else 0 for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__y").cast(pa.int32()), pa.array(low, pa.int64())], schema=arrow_schema(context)
            )

    chosen = (
        mapped(sample, contexts, context).groupBy("y", "context").agg(F.min("__id").alias("__id")).select("__id", "y").distinct()
    )
    base = stored(sample.join(F.broadcast(chosen), "__id").select("y", "text"), "toxicity-base")
    sizes = {r.y: r["count"] for r in base.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return seeds
    pos = {r.term: r.n for r in mapped(base.where("y = 1").select("text"), _count_terms, _COUNTS).groupBy("term").agg(F.sum("n").alias("n")).where("n >= 3").collect()}
    forms = threat_forms()
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(pos) | frozenset(forms))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        neg: Counter = Counter()
        for batch in batches:
            own = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                terms = _terms(text or "") & shared.value
                if y:
                    own.append(sorted(terms))
                else:
                    neg.update(terms)
            yield pa.RecordBatch.from_pydict({"terms": own, "term": [None] * len(own), "n": [0] * len(own)}, schema=arrow_schema(_LISTS))
        yield pa.RecordBatch.from_pydict({"terms": [None] * len(neg), "term": list(neg), "n": list(neg.values())}, schema=arrow_schema(_LISTS))

    found = stored(mapped(base.select("y", "text"), lists, _LISTS), "toxicity-terms")
    neg = {r.term: r.n for r in found.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    best = {t for t, p in pos.items() if _log_odds(p, neg.get(t, 0), sizes[1], sizes[0])[0] > 1.5}
    toxic = [[t for t in r.terms if t in best] for r in found.where("term is null").select("terms").toLocalIterator()]
    weights = _choose(toxic, {t: pos[t] for t in best}, neg, sizes[0])
    model = Model(
        {t: w for t, w in weights.items() if t[-1] != "*"},
        {t[:-1]: w for t, w in weights.items() if t[-1] == "*"},
        _threat_weights(forms, pos, neg, sizes),
    )
    names = [f"f{i}" for i in range(2 + len(PATTERNS))]
    feature = T.StructType([T.StructField("y", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            made = np.array([scorer.features(scorer.clauses(t or "")) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("y"), *map(pa.array, made.T)] if batch.num_rows else [batch.column("y"), *[pa.array([], pa.float64())] * len(names)], schema=arrow_schema(feature))

    fitted = mapped(base, features, feature).toPandas().sort_values([*names, "y"])  # a row of numbers for each of at most ``rows``
    return Model(model.words, model.prefixes, model.threats, _logistic(fitted[names].to_numpy(), fitted["y"].to_numpy()))


def _threat_weights(forms: dict[str, str], pos: dict[str, int], neg: dict[str, int], sizes: dict[int, int]) -> dict[str, float]:
    """Log-odds of each threat, all its forms together, between what is seen and what is assumed of unseen ones."""
    out = {}
    for stem in set(forms.values()):
        mine = [f for f, s in forms.items() if s == stem]
        p, n = (sum(c.get(f, 0) for f in mine) for c in (pos, neg))
        value = _log_odds(p, n, sizes[1], sizes[0])[0]
        out[stem] = max(0.0, min(6.0, ((p + n) * value + 4 * SEED_WEIGHT) / (p + n + 4)))
    return out


_CLAUSE = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("pattern", T.StringType())])
)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("score", "clauses")) -> DataFrame:
    """``docs``, each text's score (0 to 1) and its matched clauses, called ``names``; other columns pass, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made() -> Callable[[pa.RecordBatch, int], list]:
        scorer = Scorer(shared.value)

        def rows(batch: pa.RecordBatch, at: int) -> list:
            matched = [scorer.clauses(t) if t else [] for t in batch.column(at).to_pylist()]
            return [[scorer.score(m) for m in matched], [[{"start": c.start, "end": c.end, "weight": c.score, "pattern": c.pattern} for c in m] for m in matched]]

        return rows

    return extended(docs, text_col, made, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], _CLAUSE)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and the matched ``clauses`` of every row.

    Null and empty texts match nothing and get the score of a text without matches; texts of any length are read whole.  Rows are
    independent of each other: repeated rows and null ids come back as they are.  Other columns are never read, whatever
    their names.
    """
    return with_scores(docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")), model).drop("text")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score, prediction and held-out flag of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("clauses").alias("n_clauses"),
    )
