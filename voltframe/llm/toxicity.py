"""Toxicity by a weighted finite-state pattern grammar over clauses, its weights and part of its lexicon learned."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from voltframe.llm.common import documents, prepare, stored

# At most so many labelled rows of each class are looked at in fitting: the bound of the documented sample.
FIT_TOXIC, FIT_CLEAN = 3000, 6000
MIN_TOXIC, MIN_RATIO, MIN_CONTEXTS = 8, 30.0, 0.6
STEMS = (4, 5, 6)
MAX_TERMS = 2000
THRESHOLD = 0.7
WINDOW = 4

# Seed lexicon; everything else in the lexicon is learned from labelled rows.
INSULTS = (
    "ass asshole bastard bitch brainless bum cretin clown coward creep crook dimwit disgusting dumb dumbass dunce fool freak fraud "
    "garbage idiot idiotic idiots imbecile jerk liar loser losers lunatic maggot moron moronic morons nitwit parasite pathetic pig "
    "prick rat scum scumbag slime sleazebag slut stupid swine trash twit vermin whore worthless wretch "
    "abschaum arschloch blödmann depp dummkopf trottel vollidiot versager abruti connard crétin débile imbécile ordure salaud "
    "basura cabrón escoria estúpido gilipollas imbécil inútil pendejo"
).split()
THREATS = "kill hurt destroy murder strangle shoot stab beat crush burn punish attack slaughter töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours youre u ya he she they him her them his their these those du dich dir euch ihr tu te toi vous tú usted ustedes".split()
NEGATIONS = "not never no nobody isn't aren't wasn't don't doesn't won't wouldn't without nicht kein keine nie pas jamais nunca ningún".split()
REPORTS = "said says say called calls call claimed quoted quote wrote reported tweeted accused alleged sagte nannte schrieb dit appelé dijo llamó".split()

WORD = re.compile(r"[^\W\d_]+(?:'[a-z]+)?")
CLAUSE = re.compile(r"[^.!?;:\n]+")

# Symbols between the transducers: other, insult, threat, target, negation, report; on output also negated, reported and targeted ones.
EVENTS = ("insult", "aimed_insult", "negated_insult", "reported", "threat", "aimed_threat", "negated_threat")


@dataclass
class Transducer:
    """A deterministic finite-state transducer: (state, symbol) -> (state, symbol); what has no arc keeps state and symbol."""

    arcs: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)
    start: int = 0

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def run(self, symbols: Iterable[str]) -> list[str]:
        state, out = self.start, []
        for symbol in symbols:
            state, symbol = self.step(state, symbol)
            out.append(symbol)
        return out

    def then(self, other: Transducer, alphabet: Iterable[str]) -> Transducer:
        """Composition: this transducer's output is the other's input."""
        names = {(self.start, other.start): 0}
        todo, arcs = [(self.start, other.start)], {}
        while todo:
            pair = todo.pop()
            for symbol in alphabet:
                a, middle = self.step(pair[0], symbol)
                b, out = other.step(pair[1], middle)
                if (a, b) not in names:
                    names[(a, b)] = len(names)
                    todo.append((a, b))
                arcs[(names[pair], symbol)] = (names[(a, b)], out)
        return Transducer(arcs)


def windowed(opener: str, changes: dict[str, str], symbols: str, width: int = WINDOW) -> Transducer:
    """After ``opener``, for ``width`` more words, symbols change as told."""
    arcs = {}
    for state in range(width + 1):
        for s in symbols:
            after = width if s == opener else max(0, state - 1)
            arcs[(state, s)] = (after, changes.get(s, s) if state else s)
    return Transducer(arcs)


BASE = "oihtnr"


def grammar() -> Transducer:
    """Negation, reported speech, aim before and aim after, composed into one transducer over the lexical symbols."""
    negation = windowed("n", {"i": "j", "h": "k"}, BASE)
    # Reported speech holds to the end of the clause.
    report = Transducer({(0, "r"): (1, "r")} | {(1, s): (1, "q") for s in "ih"})
    aim = windowed("t", {"i": "I"}, BASE + "jkq")
    # A threat is aimed if a target follows; the target's word then gives the event.
    strike = windowed("h", {"t": "H"}, BASE + "jkqI")
    return negation.then(report, BASE).then(aim, BASE).then(strike, BASE)


GRAMMAR = grammar()
EVENT_OF = dict(zip("iIjqhHk", range(len(EVENTS))))


@dataclass
class Lexicon:
    """Whole words and stems (a stem matches any word that begins with it) of the symbols insult and threat."""

    words: dict[str, str]
    stems: frozenset[str]

    def __post_init__(self) -> None:
        self._find = None
        self._context = dict(zip(TARGETS, repeat("t"))) | dict(zip(NEGATIONS, repeat("n"))) | dict(zip(REPORTS, repeat("r")))

    def symbol(self, word: str) -> str:
        if (s := self.words.get(word)) is not None:
            return s
        if any(word[:n] in self.stems for n in STEMS):
            return "i"
        return self._context.get(word, "o")

    def hits(self, low: str) -> list[int]:
        """Places in a lower-case text where a word of the lexicon starts."""
        if self._find is None:
            self._find = ahocorasick.Automaton()
            for term in (*self.words, *self.stems):
                self._find.add_word(term, term)
            self._find.make_automaton()
        found = []
        for end, term in self._find.iter(low):
            at = end - len(term) + 1
            if (at == 0 or not low[at - 1].isalpha()) and (term in self.stems or end + 1 == len(low) or not low[end + 1].isalpha()):
                found.append(at)
        return found

    def __getstate__(self) -> tuple:
        return self.words, self.stems

    def __setstate__(self, state: tuple) -> None:
        self.words, self.stems = state
        self.__post_init__()


def seed_lexicon(stems: Iterable[str] = (), words: Iterable[str] = ()) -> Lexicon:
    return Lexicon(dict(zip(words, repeat("i"))) | dict(zip(INSULTS, repeat("i"))) | dict(zip(THREATS, repeat("h"))), frozenset(stems))


N_FEATURES = len(EVENTS) + 5


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Event counts (logarithmic) of the matched clauses, their number, distinct terms, repetition and density."""
    out = np.zeros(N_FEATURES)
    low = (text or "").lower()
    hits = lexicon.hits(low) if low else []
    if not hits:
        return out
    events: Counter[str] = Counter()
    terms: set[str] = set()
    clauses, k = 0, 0
    hits = sorted(set(hits))
    for clause in CLAUSE.finditer(low):
        if k == len(hits):
            break
        if hits[k] >= clause.end():
            continue
        while k < len(hits) and hits[k] < clause.end():
            k += 1
        words = WORD.findall(clause.group())
        symbols = [lexicon.symbol(w) for w in words]
        terms.update(w for w, s in zip(words, symbols) if s in "ih")
        events.update(s for s in GRAMMAR.run(symbols) if s in EVENT_OF)
        clauses += 1
    for s, n in events.items():
        out[EVENT_OF[s]] = math.log1p(n)
    insults = sum(events[s] for s in "iIH")
    out[len(EVENTS) :] = (math.log1p(clauses), math.log1p(len(terms)), float(insults >= 1), float(insults >= 2), min(1.0, 200 * insults / len(low)))
    return out


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 3 == 1


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three independent smallest shingle hashes per text: near copies share most of them."""
    for batch in batches:
        signs = []
        for text in batch.column(1).to_pylist():
            words = (text or "").lower().split()
            h = np.array([xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], dtype=np.uint64)
            signs.append([int((h * np.uint64(m)).min().view(np.int64)) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)])
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s, pa.int64()) for s in (zip(*signs) if signs else ((), (), ())))], names=["_id", "_text", "_toxic", "_s0", "_s1", "_s2"])


def fit_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The bounded sample of labelled rows that are not held out, without copies and most near copies (stored)."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(id_col).agg(F.max("toxic").alias("_toxic"))
    parts = [
        known.filter(F.col("_toxic") == v).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(n) for v, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))
    ]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col)
    signed = rows.select(F.col(id_col).cast("string").alias("_id"), "_text", F.col("_toxic").cast("int")).mapInArrow(
        _signed, "_id string, _text string, _toxic int, _s0 long, _s1 long, _s2 long"
    )
    for s in ("_s0", "_s1", "_s2"):
        signed = signed.groupBy(s, "_toxic").agg(F.min_by(F.struct(*[c for c in signed.columns if c not in (s, "_toxic")]), "_id").alias("_r")).select(s, "_toxic", "_r.*")
    return stored(signed.select("_id", "_text", "_toxic"))


def _terms(text: str | None) -> set[tuple[str, str]]:
    """(term, word before) of all words and stems; a stem is written with a trailing ``*``."""
    found, before = set(), ""
    for word in WORD.findall((text or "").lower()):
        if len(word) > 2:
            found.add((word, before))
            for n in STEMS:
                if len(word) >= n:
                    found.add((word[:n] + "*", before))
        before = word
    return found


def _toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, t, b) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t, b in _terms(text)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ((), (), ()))], names=["id", "term", "before"])


def _clean_terms(candidates: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update({t for t, _ in _terms(text)} & candidates)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return run


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Seed words plus words and stems that stand in many toxic texts, after many different words, and in few clean ones."""
    sizes = dict(sample.groupBy("_toxic").count().collect())
    toxic = sample.filter("_toxic = 1").select("_id", "_text").mapInArrow(_toxic_terms, "id string, term string, before string")
    wide = (
        toxic.groupBy("term").agg(F.countDistinct("id").alias("n"), F.countDistinct("before").alias("contexts"))
        .filter((F.col("n") >= MIN_TOXIC) & (F.col("contexts") >= MIN_CONTEXTS * F.col("n")))
        .orderBy(F.desc("n"), "term").limit(20 * MAX_TERMS).collect()
    )
    candidates = frozenset(r["term"] for r in wide)
    clean = sample.filter("_toxic = 0").select("_text").mapInArrow(_clean_terms(candidates), "term string, n long")
    in_clean = dict(clean.groupBy("term").agg(F.sum("n")).collect())
    share = lambda n, of: (n + 0.5) / (of + 1.0)
    ratio = {r["term"]: share(r["n"], sizes.get(1, 0)) / share(in_clean.get(r["term"], 0), sizes.get(0, 0)) for r in wide}
    chosen = [t for t in sorted(ratio, key=lambda t: (-ratio[t], t)) if ratio[t] >= MIN_RATIO][:MAX_TERMS]
    # A stem that (nearly) always goes on in the same way gives way to the longer stem or the word.
    count = {r["term"]: r["n"] for r in wide}
    exact: set[str] = set()
    for stem in sorted((t for t in chosen if t.endswith("*")), key=len):
        longer = [t for t in chosen if t != stem and t.startswith(stem[:-1]) and count[t] >= 0.95 * count[stem]]
        exact.add(max(longer, key=lambda t: (not t.endswith("*"), len(t), t)) if longer else stem)
    exact.update(t for t in chosen if not t.endswith("*"))
    stems: set[str] = set()
    for stem in sorted((t[:-1] for t in exact if t.endswith("*")), key=len):
        if not any(stem[:n] in stems for n in STEMS):
            stems.add(stem)
    words = [t for t in sorted(exact) if not t.endswith("*") and not any(t[:n] in stems for n in STEMS)]
    return seed_lexicon(stems, words)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = float(features(text, self.lexicon) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, lexicon).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and weights from the bounded sample; the score is moved so that 0.7 is the best cut for F1 on it.

    Without labels of both classes the seed lexicon is used with plain weights.
    """
    sample = fit_rows(docs, labels, id_col, text_col)
    lexicon = learn_lexicon(sample)
    rows = sample.select("_toxic", "_text").mapInArrow(_featured(lexicon), "y int, x array<double>").collect()
    y = np.array([r["y"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        weights = np.array([1.0, 1.5, -0.5, 0.2, 0.5, 2.0, 0.0, 0.5, 0.5, 0.5, 1.0, 0.5, -2.5])
        return Model(lexicon, weights)
    x = np.array([r["x"] for r in rows])
    weights = logistic(x, y, np.ones(len(y)))
    z = x @ weights[:-1] + weights[-1]
    cuts = np.unique(np.quantile(z, np.linspace(0, 1, 400)))
    middle = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    f1 = [2 * (y * (z >= c)).sum() / max(1.0, y.sum() + (z >= c).sum()) for c in middle]
    best = [c for c, f in zip(middle, f1) if f >= max(f1) - 1e-9]
    weights[-1] += math.log(THRESHOLD / (1 - THRESHOLD)) - float(best[len(best) // 2])
    return Model(lexicon, weights)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` per row. Only the text counts. Null and empty texts have the score of a text without any event."""
    from pyspark.sql import types as T

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([rows.schema["_id"], T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), schema)
    return scored.select(F.col("_id").alias("id"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = documents(spark, sf_dir)
    model = fit(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity(docs, model)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", "predicted")
