"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.llm.common import documents
from voltframe.llm.wordcache import Generations

UNKNOWN = "und"
# The bounded sample a model is fitted on: documents and word sequences of each language, and words of a sequence.
FIT_DOCS, FIT_SEQUENCES, SEQUENCE = 400, 1500, 64
BUCKETS = 1 << 15
LEXICON, LEXICON_MIN = 4000, 3
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.3, 1e-5
CACHE = 150_000

WORD = re.compile(r"[^\W\d_]+")


def sequences(text: str | None) -> list[list[str]]:
    """Lower-case words, a sequence per line; long lines are cut into sequences of ``SEQUENCE`` words."""
    found = []
    for line in (text or "").lower().split("\n"):
        # Numerals such as fractions match the pattern, but a word has a letter.
        words = [w for w in WORD.findall(line) if w.isalpha() or any(map(str.isalpha, w))]
        found += [words[i : i + SEQUENCE] for i in range(0, len(words), SEQUENCE)]
    return found


def word_features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Hashed affixes, letter n-grams and the word itself if the lexicon has it."""
    padded = f"<{word}>"
    names = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    names += [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]
    names.append(f"w{word}" if word in lexicon else "w")
    return [crc32(name.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for name in names]


def scores(words: list[str], lexicon: frozenset[str], weights: np.ndarray) -> np.ndarray:
    """Emission scores, one row per word: the mean weight of its features times the root of their number."""
    features = [word_features(w, lexicon) for w in words]
    sizes = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    flat = np.fromiter((i for f in features for i in f), dtype=np.int64, count=int(sizes.sum()))
    sums = np.add.reduceat(weights[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
    return sums / np.sqrt(sizes)[:, None]


def forward_backward(potentials: np.ndarray, sizes: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word's label, and the summed marginals of label pairs, of many chains at once.

    ``potentials`` holds the chains' words one after the other, ``sizes`` the chains' lengths. All chains go forward together, longest
    first, so step t works on the chains that have a word t. Every step is scaled to sum to one.
    """
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    begins, longest = begins[order], sizes[order]
    forward, backward = np.empty_like(potentials), np.ones_like(potentials)
    steps = int(longest[0]) if len(longest) else 0
    active = [int(np.searchsorted(-longest, -t, side="left")) for t in range(steps)]
    now = None
    for t in range(steps):
        at = begins[: active[t]] + t
        now = potentials[at] * (start if t == 0 else now[: active[t]] @ move)
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    pairs = np.zeros_like(move)
    for t in range(steps - 1, 0, -1):
        at = begins[: active[t]] + t
        ahead = potentials[at] * backward[at]
        both = forward[at - 1][:, :, None] * move[None] * ahead[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = ahead @ move.T
        backward[at - 1] = back / back.sum(axis=1, keepdims=True)
    marginals = forward * backward
    return marginals / marginals.sum(axis=1, keepdims=True), pairs


def potentials_of(raw: np.ndarray) -> np.ndarray:
    return np.exp(raw - raw.max(axis=1, keepdims=True))


@dataclass
class Model:
    labels: list[str]
    lexicon: frozenset[str]
    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray


def train(labelled: list[tuple[str, list[str]]]) -> Model:
    """Fit by stochastic gradients of the likelihood of the label chains (AdaGrad); the order is fixed, so is the result."""
    labels = sorted({lang for lang, _ in labelled})
    lexicon = frozenset(w for w, n in Counter(w for _, words in labelled for w in words).most_common(LEXICON) if n >= LEXICON_MIN)
    index = {lang: i for i, lang in enumerate(labels)}
    types = sorted({w for _, words in labelled for w in words})
    place = {w: i for i, w in enumerate(types)}
    features = [np.array(word_features(w, lexicon), dtype=np.int64) for w in types]
    size = len(labels)
    weights, start, move = np.zeros((BUCKETS, size)), np.zeros(size), np.zeros((size, size))
    grads = [np.full_like(p, 1e-2) for p in (weights, start, move)]
    random = np.random.default_rng(7)
    for _ in range(EPOCHS if size > 1 else 0):
        order = random.permutation(len(labelled))
        for at in range(0, len(order), BATCH):
            chains = [labelled[i] for i in order[at : at + BATCH]]
            sizes = np.array([len(words) for _, words in chains])
            owner = np.array([index[lang] for lang, _ in chains])
            own = [features[place[w]] for _, words in chains for w in words]
            counts = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            flat, scale = np.concatenate(own), 1 / np.sqrt(counts)
            raw = np.add.reduceat(weights[flat], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0) * scale[:, None]
            marginals, pairs = forward_backward(potentials_of(raw), sizes, np.exp(start), np.exp(move))
            gold = np.zeros_like(marginals)
            gold[np.arange(len(gold)), np.repeat(owner, sizes)] = 1
            error = (gold - marginals) / len(chains)
            step = np.repeat(error * scale[:, None], counts, axis=0)
            by_word = np.stack([np.bincount(flat, weights=step[:, k], minlength=BUCKETS) for k in range(size)], axis=1)
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            stays = np.diag(np.bincount(owner, weights=sizes - 1.0, minlength=size))
            for p, g, d in zip((weights, start, move), grads, (by_word - DECAY * weights, error[first].sum(axis=0), (stays - pairs) / len(chains) - 0.01 * move)):
                g += d * d
                p += RATE * d / np.sqrt(g)
    return Model(labels, lexicon, weights.astype(np.float32), np.exp(start), np.exp(move))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _sequence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, " ".join(s)) for lang, text in zip(*(c.to_pylist() for c in batch.columns)) for s in sequences(text)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ((), ()))], names=["lang", "words"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a sample of rows with a language that are not held out.

    The sample is bounded by ``FIT_DOCS`` documents and ``FIT_SEQUENCES`` sequences of at most ``SEQUENCE`` words per language,
    those of the smallest hashes; whole documents are read to choose from.
    """
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).alias("_lang")
    )
    languages = sorted(r["_lang"] for r in known.select("_lang").distinct().collect())
    labelled: list[tuple[str, list[str]]] = []
    for lang in languages:
        ids = known.filter(F.col("_lang") == lang).select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(FIT_DOCS)
        rows = known.filter(F.col("_lang") == lang).join(F.broadcast(ids), "_id").select("_lang", "_text")
        cut = rows.mapInArrow(_sequence_rows, "lang string, words string").distinct()
        labelled += [(r["lang"], r["words"].split(" ")) for r in cut.orderBy(F.xxhash64("words"), "words").limit(FIT_SEQUENCES).collect()]
    return train(labelled)


_CACHES: dict[int, Generations] = {}


def label_words(texts: list[str | None], model: Model, cache: Generations) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all words of all texts, the text each belongs to, and the first words of chains."""
    words: list[str] = []
    sizes: list[int] = []
    owner: list[int] = []
    for row, text in enumerate(texts):
        for chain in sequences(text):
            words += chain
            sizes.append(len(chain))
            owner.append(row)
    if not words or not model.labels:
        return np.zeros((0, len(model.labels))), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def emissions(unknown: list[str]) -> list[bytes]:
        rows = potentials_of(scores(unknown, model.lexicon, model.weights)).astype("<f4")
        return [row.tobytes() for row in rows]

    potentials = np.frombuffer(b"".join(cache.fill(words, emissions)), dtype="<f4").reshape(len(words), -1).astype(np.float64)
    lengths = np.array(sizes)
    marginals, _ = forward_backward(np.maximum(potentials, 1e-30), lengths, model.start, model.move)
    return marginals, np.repeat(owner, lengths), np.concatenate(([0], np.cumsum(lengths)[:-1]))


def language_runs(text: str | None, model: Model) -> list[tuple[int, str, float]]:
    """Runs of words in one language, in order: number of words, language, mean marginal."""
    marginals, _, _ = label_words([text], model, Generations(CACHE))
    runs: list[list] = []
    for row in marginals:
        lang = model.labels[int(row.argmax())]
        if not runs or runs[-1][1] != lang:
            runs.append([0, lang, 0.0])
        runs[-1][0] += 1
        runs[-1][2] += float(row.max())
    return [(n, lang, total / n) for n, lang, total in runs]


def _labelled(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        if id(shared) not in _CACHES:
            _CACHES.clear()
            _CACHES[id(shared)] = Generations(CACHE)
        for batch in batches:
            n, size = batch.num_rows, len(model.labels)
            marginals, owner, _ = label_words(batch.column(1).to_pylist(), model, _CACHES[id(shared)])
            totals = np.stack([np.bincount(owner, weights=marginals[:, k], minlength=n) for k in range(size)], axis=1) if size else np.zeros((n, 1))
            count = np.bincount(owner, minlength=n)
            best = marginals.argmax(axis=1) if len(marginals) else np.zeros(0, dtype=np.int64)
            changes = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (best[1:] != best[:-1])], minlength=n)
            top = totals.argmax(axis=1)
            certain = np.clip(totals.max(axis=1) / np.maximum(count, 1), 0.0, 1.0)
            langs = [model.labels[k] if c and size else UNKNOWN for k, c in zip(top, count)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(np.where(count > 0, certain, 0.0)), pa.array(count.astype(np.int64)), pa.array(changes.astype(np.int64))],
                names=["_id", "lang_pred", "score", "n_words", "n_switches"],
            )

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, n_words, n_switches`` per row; only the text counts.

    The language is the one with the largest sum of word marginals, the score its mean over the text's words, ``n_switches`` the
    number of neighbouring words labelled unlike. Texts that are null or without letters are ``und`` with score 0.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType(
        [rows.schema["_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "n_switches")]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_labelled(shared), schema).withColumnRenamed("_id", "id")


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = documents(spark, sf_dir)
    found = identify(docs, fit(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
