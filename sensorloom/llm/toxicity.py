"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause one after another: insults and threats (learned
stems with weights, besides short lists) turn their words into hits, targets strengthen hits
near them and mark a target that follows one, negation and reported speech weaken hits.  They
are composed into one machine by the product of their states.  A text is scored by its
matched clauses, not by single words, and the score is calibrated on labelled rows.

The stems are word beginnings that labelled toxic texts have and clean ones hardly do, each
as long as it can be without losing the texts it stands for; one that mostly shares its clause
with a target is a threat, else an insult.  They are counted GROWTH letters at a time, and only
those that toxic texts support grow on, so words may have any length.  Fitting uses at most
``sample`` labelled rows, by hash order.

Null and empty texts match nothing and get the score of a text without matches.  Without
labels of both kinds the score is that of the built-in list alone.  Rows that repeat or share an id
are scored alike; null labels and null ids teach nothing; a label above 0 is toxic, and of several
for a document the highest counts; of several texts of an id the least teaches.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Built-in words; stems learned from labels join the first two.
INSULTS = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "loser", "disgusting", "trash", "clown", "dumb", "imbecile", "fool", "bastard", "dummkopf", "abschaum", "trottel", "crétin", "ordure", "connard", "imbécil", "estúpid", "basura")
THREATS = ("kill", "destroy", "hurt", "beat", "murder", "smash", "hang", "burn", "töten", "umbringen", "verbrennen", "tuer", "détruire", "brûler", "matar", "destruir", "quemar")
TARGETS = frozenset("you your yours yourself u they them their he him his she her people folks du dich dir dein deine ihr euch eure sie ihn ihm tu te toi ton ta vous votre ils leur elle tú ti usted ustedes él ella ellos vosotros".split())
NEGATIONS = frozenset("not no never nobody none neither nor without isn't aren't wasn't weren't don't doesn't didn't won't can't nicht kein keine keinen nie niemals niemand ohne ne pas jamais aucun aucune personne sans nunca jamás ningún ninguna nadie sin".split())
REPORTS = frozenset("said says say saying told tells called calls claimed claims wrote writes reported reports quote quotes quoted according sagt sagte sagten nannte meinte schrieb behauptete laut dit disait disent appelé affirme écrit selon dijo dice dicen llamó escribió afirma según".split())

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]")
_FEATURES = 4
#: Stems that a task counts before it hands them on, and the letters by which stems grow.
STEMS, GROWTH = 200_000, 12
PLAIN, TARGET, NEGATION, REPORT, INSULT, THREAT, HIT, AIM = range(8)


class Transducer:
    """moves: (state, symbol) -> (state, symbol, weight); what isn't listed passes unchanged with weight 1.  State 0 begins."""

    def __init__(self, states: int, moves: dict[tuple[int, int], tuple[int, int, float]]):
        self.states, self.moves = states, moves

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.moves.get((state, symbol), (state, symbol, 1.0))

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes; a state is a pair, weights multiply."""
        moves = {}
        for s in range(self.states):
            for t in range(other.states):
                for symbol in range(8):
                    s2, middle, w = self.step(s, symbol)
                    t2, out, v = other.step(t, middle)
                    moves[s * other.states + t, symbol] = s2 * other.states + t2, out, w * v
        return Transducer(self.states * other.states, moves)


INSULTING = Transducer(1, {(0, INSULT): (0, HIT, 1.0)})
#: A threat counts half as long as the clause has no target.
THREATENING = Transducer(2, {(0, TARGET): (1, TARGET, 1.0), (0, THREAT): (0, HIT, 0.5), (1, THREAT): (1, HIT, 1.5)})
#: States: nothing, a target, a hit, both.  A target after the hit also makes it one that is aimed.
TARGETING = Transducer(4, {(0, TARGET): (1, TARGET, 1.0), (0, HIT): (2, HIT, 1.0), (1, HIT): (3, HIT, 1.5), (2, TARGET): (3, AIM, 0.25), (3, HIT): (3, HIT, 1.5)})
#: A negation is in force up to the next hit, a report to the end of the clause.
NEGATING = Transducer(2, {(0, NEGATION): (1, NEGATION, 1.0), (1, HIT): (0, HIT, 0.3)})
REPORTING = Transducer(2, {(0, REPORT): (1, REPORT, 1.0), (1, HIT): (1, HIT, 0.6)})
MACHINE = INSULTING.then(THREATENING).then(TARGETING).then(NEGATING).then(REPORTING)
STEP = [[MACHINE.step(s, c)[0] for c in range(8)] for s in range(MACHINE.states)]
#: The weight of what the machine writes; only hits and targets that aim them count.
FACTOR = [[w if out in (HIT, AIM) else 0.0 for _, out, w in (MACHINE.step(s, c) for c in range(8))] for s in range(MACHINE.states)]


class Grammar:
    """Weights by stem, and the machine that reads clauses."""

    def __init__(self, insults: dict[str, float], threats: dict[str, float]):
        self.insults, self.threats = dict(insults), dict(threats)
        self.find = ahocorasick.Automaton()
        for kind, stems in ((THREAT, self.threats), (INSULT, self.insults)):
            for stem, weight in stems.items():
                self.find.add_word(stem, (len(stem), kind, weight))
        self.find.make_automaton()

    def __reduce__(self):
        return Grammar, (self.insults, self.threats)

    def clauses(self, text: str) -> list[float]:
        """The weights of the clauses of a lower-cased text that match; each clause with a stem is read once, from end to end."""
        at: dict[int, tuple[int, float]] = {}
        for end, (n, kind, weight) in self.find.iter(text):
            start = end - n + 1
            if start and text[start - 1].isalpha():
                continue
            if start not in at or at[start][1] < weight:
                at[start] = kind, weight
        if not at:
            return []
        out, stops, begin = [], (m.start() for m in _CLAUSE.finditer(text)), 0
        end = next(stops, len(text))
        for start in sorted(at):
            if start < begin:
                continue
            while end <= start:
                begin, end = end + 1, next(stops, len(text))
            out.append(self.read(text, begin, end, at))
            begin, end = end + 1, next(stops, len(text))
        return [x for x in out if x > 0]

    def read(self, text: str, begin: int, end: int, at: dict) -> float:
        state, total, weight = 0, 0.0, 1.0
        for m in _WORD.finditer(text, begin, end):
            found = at.get(m.start())
            if found:
                symbol, weight = found
            else:
                w = m.group()
                symbol = TARGET if w in TARGETS else NEGATION if w in NEGATIONS else REPORT if w in REPORTS else PLAIN
            total += FACTOR[state][symbol] * weight
            state = STEP[state][symbol]
        return total

    def features(self, text: str) -> list[float]:
        found = self.clauses(text)
        total = sum(found)
        return [math.log1p(total), math.log1p(len(found)), max(found, default=0.0), total / (20 + len(text) / 6)]


def _stem_rows(grown: frozenset[str] | None, low: int, high: int):
    """How many toxic and clean texts have each word beginning of low to high letters, and how many toxic ones with a target in its clause.

    grown: the beginnings of low - 1 letters that go on, or None for all.  Counts are summed over parts of a task.
    """

    def told(counts):
        return pa.record_batch([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(3))], names=["stem", "toxic", "clean", "aimed"])

    def run(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                stems: dict[str, bool] = {}
                for clause in _CLAUSE.split(text.lower()):
                    words = set(_WORD.findall(clause))
                    aimed = not words.isdisjoint(TARGETS)
                    for w in words:
                        if grown is None or w[: low - 1] in grown:
                            for k in range(low, min(len(w), high) + 1):
                                stems[w[:k]] = aimed or stems.get(w[:k], False)
                for stem, aimed in stems.items():
                    c = counts.setdefault(stem, [0, 0, 0])
                    c[1 - toxic] += 1
                    c[2] += toxic and aimed
                if len(counts) > STEMS:
                    yield told(counts)
                    counts = {}
        yield told(counts)

    return run


def learned_stems(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Insult and threat stems with their log odds, from rows (text, toxic)."""
    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    bad = int(totals[0] or 0)
    good = int(totals[1]) - bad
    if not bad or not good:
        return {}, {}
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    least, low, grown = max(5, bad // 200), 3, None
    df: dict[str, tuple[int, float, int]] = {}
    while grown is None or grown:
        high = low + GROWTH - 1
        counted = rows.mapInArrow(_stem_rows(grown, low, high), "stem string, toxic long, clean long, aimed long").groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "aimed")))
        found = counted.where(F.col("toxic") >= least).withColumn("odds", odds).where(F.col("odds") > 4.0).collect()
        df |= {r.stem: (r.toxic, r.odds, r.aimed) for r in found}
        grown, low = frozenset(r.stem for r in found if len(r.stem) == high), high + 1
    child: dict[str, int] = {}
    for stem, (n, *_) in df.items():
        child[stem[:-1]] = max(child.get(stem[:-1], 0), n)
    # As long as the texts stay the same, and then not longer.
    full = {stem for stem, (n, *_) in df.items() if child.get(stem, 0) < 0.9 * n}
    kept = sorted(stem for stem in full if not any(stem[:k] in full for k in range(3, len(stem))))
    parts: tuple[dict[str, float], dict[str, float]] = {}, {}
    for stem in kept:
        n, weight, aimed = df[stem]
        parts[2 * aimed > n][stem] = round(float(weight), 4)
    return parts


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the last one the intercept, by Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(grammar: Grammar):
    def run(batches):
        for batch in batches:
            x = np.array([grammar.features(t.lower()) for t in batch["text"].to_pylist()], float).reshape(-1, _FEATURES)
            yield pa.record_batch([batch["toxic"], *(pa.array(x[:, k]) for k in range(_FEATURES))], names=["toxic", *(f"f{k}" for k in range(_FEATURES))])

    return run


class Model:
    def __init__(self, grammar: Grammar, weights: np.ndarray, scale: np.ndarray):
        self.grammar, self.weights, self.scale = grammar, weights, scale

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.grammar.features(t.lower()) for t in texts], float).reshape(-1, _FEATURES)
        return 1 / (1 + np.exp(-np.clip((x / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``sample`` labelled rows of docs."""
    marks = labels.groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.max(F.col(label_col)) > 0).cast("long").alias("toxic")).where("toxic IS NOT NULL AND _id IS NOT NULL")
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    # Copies of a text support a stem once.
    insults, threats = learned_stems(rows.groupBy(F.xxhash64("text")).agg(F.min_by("text", "toxic").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    known = {**insults, **threats}
    built_in = lambda words, weight: {w: weight for w in words if not any(w.startswith(s) for s in known)}
    grammar = Grammar({**built_in(INSULTS, 6.0), **insults}, {**built_in(THREATS, 1.0), **threats})
    seen = rows.mapInArrow(_featured(grammar), "toxic long, " + ", ".join(f"f{k} double" for k in range(_FEATURES))).toPandas()
    y = seen["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model(grammar, np.array([0.5, 0.5, 0.05, 0.5, -3.0]), np.ones(_FEATURES))
    x = seen.drop(columns="toxic").to_numpy(float)
    scale = np.maximum(x.std(0), 1e-9)
    return Model(grammar, logistic(x / scale, y), scale)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and score (0 to 1) for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], batch["text_hash"], pa.array(model.scores(batch["text"].to_pylist()))], names=["doc_id", "text_hash", "score"])

    return mine.mapInArrow(run, "doc_id long, text_hash long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(model.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str, parts: int) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(fold("doc_id", 4) != 2))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
