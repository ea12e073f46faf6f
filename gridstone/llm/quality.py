"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each whole text. Expectation-maximisation over the counts of all vote
patterns (a table bounded by the number of patterns, from every document) estimates how accurate each labeller is, without any true label; the posterior of a
pattern is its documents' label. These labels train a linear scorer on hashed features, which scores every document.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 12
GOOD, NONE, BAD = 1, 0, -1
#: Characters or bytes of one text that are looked at at a time, so a long text needs bounded memory; words over which variety is measured.
CHUNK, WINDOW = 1 << 20, 1000
#: Common function words of four languages (fixed values).
FUNCTION_WORDS = frozenset("the of and to in is that for it on as with be by at this from or an are was have not but he she we they you a der die das und ist in den von zu mit im für auf nicht ein eine sich des dem le la les et de des est en un une que qui dans pour pas sur au du par el los las y en es un una por con para del se al lo su".split())
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "*%$#&|@^~<>{}[]\\_=+"]] = True


def _kinds() -> np.ndarray:
    """A class for each byte: lower, upper, digit, space, line end, other letter byte; each further sign is its own class."""
    kind = np.arange(256, dtype=np.uint32) + 8
    for lo, hi, k in (("a", "z", 0), ("A", "Z", 1), ("0", "9", 2)):
        kind[ord(lo) : ord(hi) + 1] = k
    kind[[9, 11, 12, 13, 32]] = 3
    kind[10] = 4
    kind[128:] = 5
    return kind


_KIND = _kinds()
LABELLERS = ("symbols", "capitals", "repeats", "variety", "exclaims", "sentences", "function words", "word length", "letters", "prose")


def blocks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The whole text in blocks of at least ``size`` characters that end before white space, so that no word is cut."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def measures(text: str, size: int = CHUNK) -> dict[str, float]:
    """Shares that the labellers judge, over the whole text and by one rule at every length.

    Variety falls with length, so it is measured over windows of WINDOW words (the last may be shorter) and averaged by their words.
    """
    count, n, repeats, function, windows, last, rest = np.zeros(256, np.int64), 0, 0, 0, 0.0, None, []

    def variety(window: list[str]) -> float:
        return len(set(window)) / max(len(window), 1) ** 0.75 * len(window)

    for block in blocks(text, size):
        count += np.bincount(np.frombuffer(block.encode("utf-8", "replace"), np.uint8), minlength=256)
        low = [w.strip(".,;:!?\"'()").lower() for w in block.split()]
        n += len(low)
        repeats += sum(map(operator.eq, low, low[1:])) + (bool(low) and low[0] == last)
        function += sum(map(FUNCTION_WORDS.__contains__, low))
        last = low[-1] if low else last
        rest += low
        whole = len(rest) - len(rest) % WINDOW
        windows += sum(variety(rest[at : at + WINDOW]) for at in range(0, whole, WINDOW))
        rest = rest[whole:]
    windows += variety(rest)
    bytes_, upper, lower = max(int(count.sum()), 1), int(count[65:91].sum()), int(count[97:123].sum())
    return {
        "words": n,
        "symbols": count[_SYMBOL].sum() / bytes_,
        "capitals": upper / max(upper + lower, 1),
        "repeats": repeats / max(n - 1, 1),
        "variety": windows / max(n, 1),
        "exclaims": int(count[33]) / max(n, 1),
        "sentences": int(count[33] + count[46] + count[63]) / max(n, 1),
        "function": function / max(n, 1),
        "length": len(text) / max(n, 1),
        "letters": (upper + lower + int(count[128:].sum())) / bytes_,
    }


def votes(m: dict[str, float]) -> list[int]:
    """One vote a labeller: all but the last vote bad or nothing, the last votes good or nothing.

    Texts of fewer than 5 words are too short for most shares to mean anything; only symbols judge them.
    """
    few = m["words"] < 5
    bad = [
        m["symbols"] > 0.05,
        not few and m["capitals"] > 0.5,
        not few and m["repeats"] > 0.25,
        not few and m["variety"] < 0.45,
        not few and m["exclaims"] > 0.3,
        not few and (m["sentences"] < 0.004 or m["sentences"] > 0.6) and m["words"] > 20,
        not few and m["function"] < 0.03 and m["words"] > 20,
        not few and (m["length"] > 20 or m["length"] < 2.5),
        not few and m["letters"] < 0.62,
    ]
    prose = m["words"] < 20 or m["function"] > 0.08 and m["repeats"] < 0.1 and m["capitals"] < 0.3 and m["sentences"] < 0.5
    return [*(BAD if b else NONE for b in bad), GOOD if prose and m["symbols"] < 0.02 and m["letters"] > 0.65 else NONE]


@dataclass
class LabelModel:
    """The share of good texts, and for each labeller the chances of its votes on bad and on good ones: (labellers, 2 classes, 3 votes)."""

    prior: float
    chance: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance that texts with these votes are good."""
        at = patterns + 1
        like = np.log(self.chance)[np.arange(at.shape[1])[None], :, at].sum(1) + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller, how often a vote that it casts is right, if both classes are equally common."""
        right = self.chance[:, 0, 0] + self.chance[:, 1, 2]
        return right / (right + self.chance[:, 0, 2] + self.chance[:, 1, 0])


def fit_labels(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.8, rounds: int = 100) -> LabelModel:
    """EM from labellers that are thought right 4 times of 5; the start keeps the classes from changing places."""
    k = patterns.shape[1]
    chance = np.tile(np.array([[0.4, 0.5, 0.1], [0.1, 0.5, 0.4]]), (k, 1, 1))
    model = LabelModel(prior, chance)
    if not len(counts):
        return model
    hot = (patterns[:, :, None] + 1 == np.arange(3)).astype(float)  # patterns x labellers x votes
    for _ in range(rounds):
        good = model.posterior(patterns)
        share = np.stack((counts * (1 - good), counts * good), 1)
        seen = np.einsum("pc,pkv->kcv", share, hot) + np.array([[0.4, 0.5, 0.1], [0.1, 0.5, 0.4]])  # one text's worth of the start
        model = LabelModel(float(np.clip(share[:, 1].sum() / counts.sum(), 0.01, 0.99)), seen / seen.sum(2, keepdims=True))
    return model


def buckets(text: str, size: int = CHUNK) -> Iterator[np.ndarray]:
    """Hashed features of the whole text: every 4-gram of byte classes, chunk by chunk (chunks overlap by 3 bytes)."""
    data = text.encode("utf-8", "replace")
    for at in range(0, max(len(data), 1), size):
        a = _KIND[np.frombuffer(data[at : at + size + 3], np.uint8)]
        if len(a) >= 4:
            yield ((a[:-3] * np.uint32(0x9E3779B1) ^ a[1:-2] * np.uint32(0x85EBCA6B) ^ a[2:-1] * np.uint32(0xC2B2AE35) ^ a[3:] * np.uint32(0x27D4EB2F)) >> np.uint32(20)) % np.uint32(BUCKETS - 16) + np.uint32(16)


def features(text: str) -> tuple[list[int], np.ndarray]:
    """The votes, and shares of hashed buckets; the first 16 buckets hold the measures."""
    m = measures(text)
    out = np.zeros(BUCKETS, np.float64)
    for b in buckets(text):
        out += np.bincount(b, minlength=BUCKETS)
    out *= 10 / max(out.sum(), 1)
    out[:10] = [1.0, min(8 * m["symbols"], 2), 2 * m["capitals"], 3 * m["repeats"], min(m["variety"], 3), min(2 * m["exclaims"], 2), min(2 * m["sentences"], 2), 3 * m["function"], min(m["length"] / 10, 3), m["letters"]]
    return votes(m), out.astype(np.float32)


@dataclass
class Scorer:
    weights: np.ndarray

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def fit_scorer(x: np.ndarray, good: np.ndarray, rounds: int = 400, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels, both classes weighed equally, by accelerated gradient descent."""
    weigh = good / max(good.sum(), 1e-9) + (1 - good) / max((1 - good).sum(), 1e-9)
    weigh = (weigh / weigh.sum()).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    z, t = w.copy(), 1.0
    step = 4 / float((weigh * np.einsum("ij,ij->i", x, x)).sum() + 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        new = z - step * (x.T @ ((p - good) * weigh) + decay * z)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + np.float32((t - 1) / after) * (new - w), new, after
    return Scorer(w.astype(np.float32))


@dataclass
class Quality:
    labels: LabelModel
    scorer: Scorer


def fit(docs: DataFrame, sample: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> Quality:
    """Label model from the vote patterns of all documents; scorer from at most ``sample`` of them (a documented bound).

    The sample takes the documents whose ids and texts have the smallest hashes. Null texts count as empty.
    """
    source = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("order"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [votes(measures(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, v)) for v in found], pa.string())], names=["pattern"])

    patterns = source.select("text").mapInArrow(vote, "pattern string").groupBy("pattern").count().orderBy("pattern").collect()  # at most 2 ** 10 rows
    table = np.array([[int(v) for v in r[0].split()] for r in patterns], int).reshape(-1, len(LABELLERS))
    labels = fit_labels(table, np.array([r[1] for r in patterns], float))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([" ".join(map(str, v)) for v, _ in found], pa.string()), pa.array([x.astype(np.float16).tobytes() for _, x in found], pa.binary())], names=["order", "pattern", "x"])

    edge = source.select("order").orderBy("order").limit(sample).agg(F.max("order")).first()[0]
    if edge is None:
        return Quality(labels, Scorer(np.zeros(BUCKETS, np.float32)))
    chosen = source.where(F.col("order") <= edge).dropDuplicates(["order"]).mapInArrow(take, "order long, pattern string, x binary").toArrow().sort_by("order")
    x = np.frombuffer(b"".join(chosen["x"].to_pylist()), np.float16).reshape(len(chosen), BUCKETS).astype(np.float32)
    good = labels.posterior(np.array([[int(v) for v in p.split()] for p in chosen["pattern"].to_pylist()])).astype(np.float32)
    return Quality(labels, fit_scorer(x, good))


def scored(docs: DataFrame, model: Quality, text_col: str = "text", also: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("posterior", "score")) -> DataFrame:
    """``(*also, posterior, score)``, or by other ``names`` where ``also`` has columns of these: the label model's and the scorer's chance that each whole text is good.

    A null text counts as empty. Rows come back one for one; columns besides the text and ``also`` aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = also.index(text_col) if text_col in also else len(also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column(at)]
            posterior = shared.value.labels.posterior(np.array([v for v, _ in found]).reshape(-1, len(LABELLERS)))
            score = [shared.value.scorer.score(x) for _, x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(also)], pa.array(posterior, pa.float64()), pa.array(score, pa.float64())], names=[*also, *names])

    source = docs.select(*also) if text_col in also else docs.select(*also, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(also)])
    return source.mapInArrow(run, f"{schema}, {names[0]} double, {names[1]} double")
