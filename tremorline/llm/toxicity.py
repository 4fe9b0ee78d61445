"""Toxicity by a convolutional text classifier trained in numpy.

Words become sums of hashed embeddings (of the word and of its prefixes), filters
of several widths slide over them, each filter's strongest place in the whole text
is kept (max pooling), and a logistic layer gives a probability.  Thresholds are
calibrated by language on all labelled rows outside the held-out fold that the fit
did not see, at the mix of labels that the table has; the language is guessed from
the text's own function words, never read from a column.  The score maps the
language's threshold to 0.5.

Training takes a bounded sample of labelled rows (``train_rows``, at most
``train_bytes`` of text, in the order of a hash of the id, passing over what doesn't
fit) on the driver, from four fifths of them.  Scoring takes every whole text, in segments that overlap by the
widest filter, so memory is bounded however long a text is; the thresholds come from
a histogram of the same scores, joined to the labels.

Defined results: null text counts as empty; empty texts get the score of no word;
rows without a label, with a null id or label don't train; of several labels of an
id the largest counts, of several texts the shortest trains; without labels of both kinds every score is 0; repeated rows
get equal scores; a text without any function word counts as the first language, English, as do ties between languages;
an empty table gives an empty table; a text may have any length; extra columns are kept by ``reject`` and ignored by ``judge``.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

FOLDS = 5
BUCKETS = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
PREFIXES = (4, 5, 6)
TRAIN_ROWS = 12_000
TRAIN_BYTES = 96 << 20
SEGMENT = 1 << 15
#: Steps of the probability in the histograms that thresholds come from.
STEPS = 4096
ROWS_KEPT = 200_000
WORD = re.compile(r"[^\W_]+")

#: Frequent function words by language, from which it is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with be by on are this from",
    "fr": "le la les de du des et en un une que qui pour dans est au aux",
    "de": "der die das und ist von mit den dem zu ein eine nicht im sich auch",
    "es": "el los las de y que en un una por con para del se como su",
}
LANGUAGES = tuple(FUNCTION_WORDS)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def buckets(word: str) -> list[int]:
    """Hashed places of a word and of its prefixes (a shorter word's own place stands in)."""
    out = [zlib.crc32(b"w" + word.encode("utf-8", "replace"))]
    out += [zlib.crc32(b"p%d" % n + word[:n].encode("utf-8", "replace")) for n in PREFIXES]
    return [x % BUCKETS for x in out]


_VOTES: dict[str, np.ndarray] = {}
for _i, _known in enumerate(FUNCTION_WORDS.values()):
    for _w in _known.split():
        _VOTES.setdefault(_w, np.zeros(len(LANGUAGES), dtype=np.int64))[_i] += 1
_NO_VOTES = np.zeros(len(LANGUAGES), dtype=np.int64)


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    filters: np.ndarray  # DIM x columns; a column for each (width, place, filter)
    bias: np.ndarray  # of each (width, filter)
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    empty: bool = False


def columns() -> list[list[slice]]:
    """For each width, the columns of each place in the window."""
    out, at = [], 0
    for w in WIDTHS:
        out.append([slice(at + j * FILTERS, at + (j + 1) * FILTERS) for j in range(w)])
        at += w * FILTERS
    return out


N_COLUMNS = FILTERS * sum(WIDTHS)
COLUMNS = columns()
REACH = max(WIDTHS) - 1


def new_model(rng: np.random.Generator) -> Model:
    return Model(
        (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32),
        (rng.standard_normal((DIM, N_COLUMNS)) * 0.4).astype(np.float32),
        np.zeros(FILTERS * len(WIDTHS), dtype=np.float32),
        (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32),
        -2.0,
    )


def convolve(parts: np.ndarray, n: int, bias: np.ndarray) -> np.ndarray:
    """From each token's product with every column: n windows' outputs, (width, filter) in columns.

    ``parts`` has n + REACH rows; a window that reaches beyond the text meets rows of zeros.
    """
    out = np.empty((n, FILTERS * len(WIDTHS)), dtype=np.float32)
    for i, places in enumerate(COLUMNS):
        own = out[:, i * FILTERS : (i + 1) * FILTERS]
        own[:] = bias[i * FILTERS : (i + 1) * FILTERS]
        for j, place in enumerate(places):
            own += parts[j : j + n, place]
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Scorer:
    """Scores texts in a worker; keeps the filters' products with recent words, bounded."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        # row 0 stands for what is beyond the text; new words of a segment may exceed ROWS_KEPT once
        self.parts = np.zeros((ROWS_KEPT + SEGMENT + REACH + 1, N_COLUMNS), dtype=np.float32)
        self.votes = np.zeros((len(self.parts), len(LANGUAGES)), dtype=np.int32)

    def _ids(self, tokens: list[str]) -> np.ndarray:
        known = [*map(self.rows.get, tokens)]
        if None in known:
            if len(self.rows) > ROWS_KEPT:
                self.rows.clear()
            rows, first = self.rows, len(self.rows) + 1
            known = [rows.setdefault(w, len(rows) + 1) for w in tokens]
            new = list(islice(reversed(rows), len(rows) + 1 - first))[::-1]
            if new:
                m, last = self.model, first + len(new)
                places = np.array([buckets(w) for w in new])
                self.parts[first:last] = m.table[places].sum(axis=1) @ m.filters
                self.votes[first:last] = [_VOTES.get(w, _NO_VOTES) for w in new]
        return np.array(known, dtype=np.int64)

    def look(self, tokens: list[str]) -> tuple[float, str]:
        """The probability before calibration, and the language guessed."""
        m, best, votes = self.model, None, np.zeros(len(LANGUAGES), dtype=np.int64)
        for at in range(0, max(len(tokens), 1), SEGMENT):
            own = self._ids(tokens[at : at + SEGMENT + REACH])
            n = max(1, min(len(own), SEGMENT))
            ids = np.zeros(n + REACH, dtype=np.int64)
            ids[: len(own)] = own
            top = convolve(self.parts[ids], n, m.bias).max(axis=0)
            best = top if best is None else np.maximum(best, top)
            votes += self.votes[ids[:n]].sum(axis=0)
        return float(sigmoid(np.maximum(best, 0) @ m.out + m.out_bias)), LANGUAGES[int(votes.argmax())]

    def score(self, text: str | None) -> float:
        if self.model.empty:
            return 0.0
        p, language = self.look(words(text))
        t = self.model.thresholds.get(language, 0.5)
        return 0.5 * p / t if p < t else 0.5 + 0.5 * (p - t) / (1 - t)


def train(texts: list[str | None], labels: np.ndarray, epochs: int = 6, least_steps: int = 900, batch: int = 64, rate: float = 0.03, seed: int = 7) -> Model:
    """Adam on the dense layers and Adagrad on the embeddings, gradients only where a filter's maximum is."""
    rng = np.random.default_rng(seed)
    m = new_model(rng)
    row: dict[str, int] = {}
    docs = [np.array([row.setdefault(w, len(row) + 1) for w in words(t)], dtype=np.int32) for t in texts]  # no text's words are kept
    places = np.zeros((len(row) + 1, 1 + len(PREFIXES)), dtype=np.int64)
    for w, n in row.items():
        places[n] = buckets(w)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    dense = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("filters", m.filters), ("bias", m.bias), ("out", m.out))}
    epochs = max(epochs, min(40, -(-least_steps * batch // max(1, len(docs)))))  # small samples are seen more often
    past, step = np.full(BUCKETS, 1e-6, dtype=np.float32), 0
    out_past = 1e-6
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        speed = rate / (1 + 5 * epoch / epochs)
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            ids = [docs[i] for i in chosen]
            lengths = [max(1, len(x)) for x in ids]
            joined = np.zeros(sum(lengths) + REACH * len(ids), dtype=np.int64)
            starts, at = [], 0
            for x, n in zip(ids, lengths, strict=True):
                joined[at : at + len(x)] = x
                starts.append(at)
                at += n + REACH
            unique, inverse = np.unique(joined, return_inverse=True)
            vectors = m.table[places[unique]].sum(axis=1)
            vectors[unique == 0] = 0
            parts = (vectors @ m.filters)[inverse]
            tops = np.empty((len(ids), len(m.bias)), dtype=np.float32)
            wheres = np.empty((len(ids), len(m.bias)), dtype=np.int64)
            for d, (s, n) in enumerate(zip(starts, lengths, strict=True)):
                h = convolve(parts[s : s + n + REACH], n, m.bias)
                wheres[d] = h.argmax(axis=0)
                tops[d] = h[wheres[d], np.arange(h.shape[1])]
                wheres[d] += s
            pooled = np.maximum(tops, 0)
            kept = (rng.random(pooled.shape) >= 0.2) / np.float32(0.8)  # dropout
            logits = (pooled * kept) @ m.out + m.out_bias
            error = (sigmoid(logits) - labels[chosen]) * weight[chosen] / len(ids)
            g_out = (pooled * kept).T @ error
            g_top = (error[:, None] * m.out[None, :] * kept * (tops > 0)).astype(np.float32)
            g_parts = np.zeros((len(unique), N_COLUMNS), dtype=np.float32)
            for i, spots in enumerate(COLUMNS):
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                for j, spot in enumerate(spots):
                    np.add.at(g_parts, (inverse[wheres[:, own] + j], np.arange(spot.start, spot.stop)[None, :]), g_top[:, own])
            g_vectors = g_parts @ m.filters.T
            g_vectors[unique == 0] = 0
            step += 1
            for name, g in (("filters", vectors.T @ g_parts), ("bias", g_top.sum(axis=0)), ("out", g_out)):
                first, second = dense[name]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                getattr(m, name)[...] -= (0.3 * speed * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            g_bias = float(error.sum())
            out_past += g_bias * g_bias
            m.out_bias -= speed * g_bias / out_past**0.5
            touched = np.flatnonzero(np.abs(g_vectors).sum(axis=1))
            spots, grads = places[unique[touched]].ravel(), np.repeat(g_vectors[touched], places.shape[1], axis=0)
            if len(spots):
                where, back = np.unique(spots, return_inverse=True)
                g = np.zeros((len(where), DIM), dtype=np.float32)
                np.add.at(g, back, grads)
                past[where] += (g * g).mean(axis=1)
                m.table[where] -= speed * g / np.sqrt(past[where])[:, None]
    return m


def cuts(counts: np.ndarray, whole: np.ndarray | None = None, least: int = 20) -> dict[str, float]:
    """By language, the threshold with the most right answers; too few toxic rows: the common one.

    ``counts`` has rows by language, label and step of the probability; each label's are
    weighed so that their mix is that of ``whole``, the rows by label of the whole table.
    """
    weight = np.ones(2) if whole is None else whole / np.maximum(counts.sum(axis=(0, 2)), 1)

    def best(own):
        clean, toxic = own * weight[:, None]
        # cut k: those from step k on are called toxic
        right = np.concatenate([[0], np.cumsum(clean)]) + np.concatenate([np.cumsum(toxic[::-1])[::-1], [0]])
        tops = np.flatnonzero(right >= right.max() * (1 - 1e-9))
        return float(np.clip(tops[len(tops) // 2] / STEPS, 0.02, 0.98))

    common = best(counts.sum(axis=0))
    return {x: best(own) if own[1].sum() >= least else common for x, own in zip(LANGUAGES, counts, strict=True)}


def calibrate(model: Model, texts: list[str | None], labels: np.ndarray, least: int = 20) -> None:
    """Thresholds from texts at hand."""
    scorer, counts = Scorer(model), np.zeros((len(LANGUAGES), 2, STEPS))
    for t, y in zip(texts, labels, strict=True):
        p, language = scorer.look(words(t))
        counts[LANGUAGES.index(language), int(y), min(int(p * STEPS), STEPS - 1)] += 1
    model.thresholds = cuts(counts, least=least)


def usable_labels(labels: DataFrame) -> DataFrame:
    """(label_id, toxic) by id, outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.where(F.crc32(F.col("label_id").cast("string")) % FOLDS != 0)


def choose(sized: DataFrame, rows: int, most_bytes: int) -> dict[int, tuple[int, int, int]]:
    """(toxic, size, hash of the text) by id: at most ``rows`` and ``most_bytes`` in hash order; a text that doesn't fit is passed over.

    Toxic ones take half of both at most.  If no text of a label fits, its shortest one goes in.
    """
    out, left = {}, most_bytes
    for y in (1, 0):
        own, most, room = sized.where(F.col("toxic") == y), rows // 2 if y else rows - len(out), left // 2 if y else left
        before = len(out)
        for r in own.where(F.col("size") <= room).orderBy(F.xxhash64("label_id", F.lit(3)), "label_id").limit(most).collect():
            if r.size <= room:
                out[r.label_id] = (y, r.size, r.text_hash)
                room, left = room - r.size, left - r.size
        if len(out) == before:
            for r in own.orderBy("size", "label_id").limit(1).collect():
                out[r.label_id] = (y, r.size, r.text_hash)
                left = max(0, left - r.size)
    return out


def sample(docs: DataFrame, usable: DataFrame, rows: int, most_bytes: int) -> list[tuple[int, str, int]]:
    """The rows of choose() among four fifths of the usable labelled ids that have a document; an id's shortest text stands for it."""
    usable = usable.where(F.crc32(F.concat(F.lit("calibrate"), F.col("label_id").cast("string"))) % 5 != 0)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("label_id"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    # one row for each id before the join, so that a repeated id meets its label once
    shortest = own.groupBy("label_id").agg(F.min(F.struct("size", "text_hash")).alias("s")).select("label_id", "s.size", "s.text_hash")
    chosen = choose(shared.materialize(shortest.join(usable, "label_id"), "toxicity-sizes"), rows, most_bytes)
    wanted = docs.sparkSession.createDataFrame([(i, *x) for i, x in chosen.items()], "label_id long, toxic int, size long, text_hash long")
    texts = own.join(F.broadcast(wanted), ["label_id", "size", "text_hash"]).groupBy("label_id", "toxic").agg(F.any_value("text").alias("text"))
    out = [(r.label_id, r.text, r.toxic) for r in texts.toLocalIterator()]
    return sorted(out, key=lambda r: (zlib.crc32(b"order%d" % r[0]), r[0]))


def learn(docs: DataFrame, labels: DataFrame, keep: list[str], rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> tuple[Model, DataFrame]:
    """The model, and the columns ``keep`` of all documents with what it sees in them, written once."""
    usable = shared.materialize(usable_labels(labels), "toxicity-labels")
    got = sample(docs, usable, rows, most_bytes)
    y = np.array([r[2] for r in got], dtype=np.float32)
    if not got or y.min() == y.max():
        model = new_model(np.random.default_rng(0))
        model.empty = True
        return model, docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(0.0).alias(_P), F.lit(LANGUAGES[0]).alias(_L))
    model = train([r[1] for r in got], y)
    seen = shared.materialize(look_documents(docs, model, keep), "toxicity-seen")
    by_id = seen.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(F.struct(F.xxhash64(_P, _L), F.col(_P).alias("p"), F.col(_L).alias("language"))).alias("s"))
    trained = docs.sparkSession.createDataFrame([(i,) for i in sorted({r[0] for r in got})], "label_id long")
    known = by_id.join(usable, "label_id").join(F.broadcast(trained.withColumn("trained", F.lit(True))), "label_id", "left")
    step = F.least(F.floor(F.col("s.p") * STEPS), F.lit(STEPS - 1)).cast("int")
    counts, whole = np.zeros((len(LANGUAGES), 2, STEPS)), np.zeros(2)
    # at most a row for each language, label, step and kind of use
    for r in known.groupBy(F.col("s.language").alias("language"), "toxic", step.alias("step"), F.coalesce("trained", F.lit(False)).alias("trained")).agg(F.count("*").alias("n")).collect():
        whole[r.toxic] += r.n
        if not r.trained:
            counts[LANGUAGES.index(r.language), r.toxic, r.step] += r.n
    model.thresholds = cuts(counts, whole)
    return model, seen


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Trains on a sample and calibrates on all other labelled rows."""
    return learn(docs, labels, ["doc_id"], rows, most_bytes)[0]


_P, _L = "toxicity: probability before calibration", "toxicity: language"


def look_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of docs, the probability before calibration and the language guessed."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x DIM floats
    at, kept = docs.columns.index(text), [docs.columns.index(c) for c in keep]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(_P, T.DoubleType()), T.StructField(_L, T.StringType())])

    def run(batches):
        scorer = Scorer(shipped.value)
        for batch in shared.slices(batches):
            found = [scorer.look(words(t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def calibrated(model: Model) -> Column:
    """Scorer.score() of what look_documents() found."""
    if model.empty:
        return F.lit(0.0)
    p, score = F.col(_P), F.lit(None).cast("double")
    for language, t in model.thresholds.items():
        own = F.when(p < t, 0.5 * p / t).otherwise(0.5 + 0.5 * (p - t) / (1 - t))
        score = F.when(F.col(_L) == language, own).otherwise(score)
    return score


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model, seen = learn(own, labels, ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return seen.select("doc_id", held.alias("held_out"), calibrated(model).alias("score")).select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't judged toxic, with their columns."""
    model, seen = learn(docs, labels, docs.columns)
    return seen.where(calibrated(model) < 0.5).drop(_P, _L)
