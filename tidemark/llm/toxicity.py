"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary labelled texts, one on the windows of toxic texts that ordinary
texts lack. A window that the toxic dictionary compresses shorter than the ordinary one speaks for
toxicity; how far is calibrated on labelled texts that trained neither dictionary.

Both dictionaries end in the same ordinary text, so on ordinary windows the lengths agree and their
difference comes from what only the toxic one holds: the words that labelled toxic texts have in excess.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, quoted

#: Labelled texts that a training reads at most, in the order of a hash of their id, and their
#: longest size in bytes; both bound the memory of the driver.
MAX_TRAIN_DOCS = 6000
MAX_TRAIN_BYTES = 20_000
WINDOW_WORDS = 8
#: Bytes of shared dictionary text before each window.
CARRIER_BYTES = 32
ORDINARY_BYTES = 24_000
TOXIC_BYTES = 16_000
#: Bytes of the segments that zstandard picks from toxic windows, and of the runs it compares them by.
SEGMENT_BYTES, RUN_BYTES = 32, 6
#: The share of trained texts whose labels calibrate; they train no dictionary.
CALIBRATION_PERCENT = 35

#: A word is in excess when so many toxic texts, this share of them, and so many times the usual share have it.
LEAST_TEXTS, LEAST_SHARE, LEAST_LIFT = 3, 0.01, 25
#: Letters of a word or stem. A longer form replaces its beginning when it is in so many of its texts.
LEAST_LETTERS, MOST_LETTERS, SAME_FORM = 4, 12, 0.6

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    """Everything that scoring needs; a few ten thousand bytes."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    prior: float


def spelled(words: list[bytes]) -> bytes:
    """Words as both dictionaries and all windows write them.

    The mark before a word makes its first four letters a match of the least length, six bytes, while
    four letters inside a word are none.
    """
    return b"".join([b"\n " + w for w in words]) + b"\n "


class Scorer:
    """Compresses windows with both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        raw = zstandard.DICT_TYPE_RAWCONTENT

        def lengths(content: bytes):
            params = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=16, chain_log=16, search_log=6, min_match=6, target_length=16,
                strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=raw)
            dictionary.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress

        self.by_ordinary, self.by_toxic = lengths(ordinary), lengths(toxic)
        # Text that both dictionaries end in pays for the sequence section, so one more match always shows.
        self.carrier = ordinary[-CARRIER_BYTES:]

    def features(self, text: bytes | None) -> tuple[float, ...]:
        """(largest, second, third margin of a window in bytes, share of windows with a margin)."""
        words = text.decode().lower().encode().split() if text else []
        margins = []
        for start in range(0, len(words), WINDOW_WORDS):
            window = self.carrier + spelled(words[start : start + WINDOW_WORDS])
            margins.append(len(self.by_ordinary(window)) - len(self.by_toxic(window)))
        top = sorted(margins, reverse=True)[:3]
        top += [0] * (3 - len(top))
        share = sum(m >= 3 for m in margins) / len(margins) if margins else 0.0
        return (*[float(min(max(m, 0), 40)) for m in top], share)


def _without_copies(texts: list[str]) -> list[str]:
    """One text of those that share the smallest hash of a five-word run, as near copies mostly do."""
    first: dict[int, str] = {}
    for text in texts:
        words = text.lower().split()
        runs = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
        first.setdefault(min(zlib.crc32(r.encode()) for r in runs), text)
    return list(first.values())


def _excess_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words and stems of toxic texts that ordinary texts lack, the most telling last.

    Copies count once, since all words of a copied toxic text would look telling.
    """
    def beginnings(text: str) -> set[str]:
        words = set(_WORD.findall(text.lower()))
        return {w[:n] for w in words for n in range(LEAST_LETTERS, min(len(w), MOST_LETTERS) + 1)}

    toxic = _without_copies(toxic)
    with_, without_ = Counter(), Counter()
    for texts, counts in ((toxic, with_), (ordinary, without_)):
        for text in texts:
            counts.update(beginnings(text))
    a, b = max(1, len(toxic)), max(1, len(ordinary))
    least = max(LEAST_TEXTS, LEAST_SHARE * a)
    telling = {
        w: n for w, n in with_.items() if n >= least and (n + 0.5) / (a + 1) > LEAST_LIFT * (without_[w] + 0.5) / (b + 1)
    }
    # A beginning stands for the words that share it, unless most of its texts have one longer form.
    longer = Counter()
    for w, n in telling.items():
        longer[w[:-1]] = max(longer[w[:-1]], n)
    stems = [w for w, n in telling.items() if longer[w] < SAME_FORM * n and _stems_hold(w, telling)]
    return sorted(stems, key=lambda w: (telling[w] * len(w), w))


def _stems_hold(word: str, telling: dict[str, int]) -> bool:
    """Whether no shorter beginning stands for ``word`` already."""
    return all(
        telling[word[: n + 1]] >= SAME_FORM * telling[word[:n]]
        for n in range(LEAST_LETTERS, len(word)) if word[:n] in telling
    )


def _fit_logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the intercept.

    A row counts as often as ``counts`` says.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 1e-3 * np.eye(len(w))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (counts * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _vector(features: tuple[float, ...]) -> list[float]:
    first, second, third, share = features
    return [first, second, third, share, float(first >= 3), float(second >= 3)]


def _toxic_dictionary(toxic: list[str], ordinary: list[str]) -> bytes:
    """What zstandard picks from the telling windows of toxic texts.

    A window is a run of words that toxic texts have in excess; each copy-free text is one sample of them. Whole toxic
    texts would fill the dictionary with what ordinary ones say as well. A zero byte after each word keeps its
    ending, which ordinary words share, from matching with the next mark.
    """
    stems: dict[str, list[str]] = {}
    for stem in _excess_words(toxic, ordinary):
        stems.setdefault(stem[:LEAST_LETTERS], []).append(stem)
    samples = []
    for text in _without_copies(toxic):
        words = [w for w in _WORD.findall(text.lower()) if any(w.startswith(s) for s in stems.get(w[:LEAST_LETTERS], ()))]
        if words:
            samples.append(b"".join(b"\n " + w[:MOST_LETTERS].encode() + b"\0" for w in words))
    try:
        return zstandard.train_dictionary(TOXIC_BYTES, samples, k=SEGMENT_BYTES, d=RUN_BYTES).as_bytes()
    except zstandard.ZstdError:
        # Too few samples to train on: they are the dictionary, without repeats.
        words = dict.fromkeys(w for s in samples for w in s.split(b"\0") if w)
        return b"".join(w + b"\0" for w in words)[-TOXIC_BYTES:]


def train(rows: list[tuple[str, int]], seed: int = 7, share: float | None = None) -> ToxicityModel:
    """A model from (text, label) pairs. Without a text of either label it always gives their share.

    ``share`` is the toxic share of the texts that the pairs were sampled from, by default that of the pairs.
    Scores are calibrated to it, whatever the share in the sample.
    """
    sampled = sum(y for _, y in rows) / len(rows) if rows else 0.0
    if sampled in (0.0, 1.0):
        return ToxicityModel(b"", b"", (), sampled)
    prior = sampled if share is None else share
    rng = np.random.default_rng(seed)
    held = rng.random(len(rows)) < CALIBRATION_PERCENT / 100
    parts = {y: [t for (t, label), h in zip(rows, held) if label == y and not h] for y in (0, 1)}
    # Ordinary dictionary: what zstandard picks from ordinary texts, or plain text when that is little.
    samples = [spelled(t.lower().encode().split()) for t in parts[0]]
    try:
        common = zstandard.train_dictionary(ORDINARY_BYTES, samples).as_bytes()[-ORDINARY_BYTES // 2 :]
    except zstandard.ZstdError:
        common = b"".join(samples)[: ORDINARY_BYTES // 2] or b"\n "
    toxic = _toxic_dictionary(parts[1], parts[0]) + common
    scorer = Scorer(common, toxic)
    # Texts that trained the dictionaries would look too well separated, so only the others calibrate.
    fit = [(t, y) for (t, y), h in zip(rows, held) if h]
    if len({y for _, y in fit}) < 2:
        fit = rows
    x = np.array([_vector(scorer.features(t.encode())) for t, _ in fit])
    y = np.array([float(y) for _, y in fit])
    weights = _fit_logistic(x, y, np.where(y == 1, prior / sampled, (1 - prior) / (1 - sampled)))
    return ToxicityModel(common, toxic, tuple(float(w) for w in weights), prior)


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_docs: int = MAX_TRAIN_DOCS, max_bytes: int = MAX_TRAIN_BYTES,
) -> ToxicityModel:
    """A model from a bounded sample of labelled documents, half of them toxic where there are enough.

    Labels without an id or value and documents without text are skipped; of repeated labels the larger
    counts. The sample is the same at every run and for every partitioning; the scores are calibrated to the
    toxic share of all labels, so the size of the table does not move them.
    """
    wanted = (
        labels.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(label)).cast("int").alias("y"))
        .where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64("id"))
    )
    texts = documents.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("t")).where(F.octet_length("t").between(1, max_bytes))
    chosen = None
    for y in (0, 1):
        # Twice as many ids as needed, since some labels have no text of that size.
        part = wanted.where(F.col("y") == y).orderBy("h", "id").limit(max_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * max_docs ids and flags, a few hundred kB.
    found = texts.join(F.broadcast(chosen), "id").select("t", "y", "h", "id")
    rows = [r for y in (0, 1) for r in found.where(F.col("y") == y).orderBy("h", "id", "t").limit(max_docs // 2).collect()]
    return train([(r.t, r.y) for r in rows], share=wanted.agg(F.avg("y")).first()[0])


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score``, the calibrated probability that a text is toxic, from all windows of the whole text.

    NULL, empty and white-space texts get the score of a text without any margin. Repeated rows score
    alike; input columns named ``score`` are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        scorer = Scorer(m.ordinary, m.toxic) if m.weights else None
        weights = np.array(m.weights)

        def one(raw: bytes | None) -> float:
            if scorer is None:
                return m.prior
            z = float(np.dot(_vector(scorer.features(raw)) + [1.0], weights))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return lambda batch: [[one(raw) for raw in batch]]

    return map_texts(df, text, "score double", make, keep)
