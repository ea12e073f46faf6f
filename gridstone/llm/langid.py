"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte n-grams of whole texts: letters in lower case, everything else one space, every
3- and 4-gram a bucket, so a text is the mean of its n-grams' vectors. Linear SVMs score that mean as the mean of
weights looked up per n-gram, without building the vector. The models are trained on at most ``per_language`` labelled documents of each language
(those of the smallest hashes; a documented bound).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 13
#: Families of common languages by ISO 639-1 code (fixed values); another language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk pl cs sk bg sr hr sl mk be",
    "uralic": "fi et hu",
    "indo-aryan": "hi bn mr ne ur pa gu",
    "semitic": "ar he am mt",
    "turkic": "tr az kk uz ky",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
#: Bytes of one text that are looked up at a time, so a long text needs bounded memory.
CHUNK = 1 << 20


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def letters(text: str) -> bytes:
    """Runs of letters in lower case, one space around each."""
    return b" " + _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace") + b" "


def buckets(data: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of all 3- and 4-grams, chunk by chunk."""
    for at in range(0, max(len(data) - 3, 1), CHUNK):
        a = np.frombuffer(data[at : at + CHUNK + 3], np.uint8).astype(np.uint32)
        if len(a) < 3:
            continue
        three = a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA6B) ^ a[2:] * np.uint32(0xC2B2AE35)
        yield (three >> np.uint32(19))[: CHUNK if len(a) == CHUNK + 3 else None]
        if len(a) > 3:
            yield (three[:-1] * np.uint32(5) ^ a[3:] * np.uint32(0x27D4EB2F)) >> np.uint32(19)


def features(text: str) -> np.ndarray:
    """The text's share of each bucket, times 100 to suit the solver's scale."""
    out = np.zeros(BUCKETS, np.float64)
    for b in buckets(letters(text)):
        out += np.bincount(b, minlength=BUCKETS)
    return (100 * out / max(out.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    """Pairs of classes with their SVM's weights and bias; first class positive. One set for families, one within each family."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.pairs)), 0
        for b in buckets(letters(text)):
            total += np.bincount(b, minlength=BUCKETS) @ self.weights
            n += len(b)
        return 100 * total / max(n, 1) + self.bias

    def choose(self, classes: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        """By votes, then by the sum of margins; the score is the least chance over the pairs it is in."""
        votes = {c: [0, 0.0] for c in classes}
        chance = dict.fromkeys(classes, 1.0)
        for (a, b), m in margin.items():
            if a in votes and b in votes:
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
                p = 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
                chance[a], chance[b] = min(chance[a], p), min(chance[b], 1 - p)
        best = max(sorted(votes), key=lambda c: votes[c])
        return best, chance[best]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not _LETTER.search(text) or not self.families:
            return "und", 0.0
        margin = dict(zip(self.pairs, self.margins(text).tolist()))
        family, p = self.choose([f"family:{f}" for f in self.families], margin)
        lang, q = self.choose(self.members[family.removeprefix("family:")], margin)
        return lang, float(p * q)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, classes weighed equally, by accelerated gradient descent on the whole matrix."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    z, t = w.copy(), 1.0
    step = 1 / (2 * c * float((share * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + 1e-3)
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ z[:-1] + z[-1])) * share * y
        slope = np.append(1e-3 * z[:-1] - 2 * c * (x.T @ gap), -2 * c * gap.sum()).astype(np.float32)
        new, after = z - step * slope, (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + np.float32((t - 1) / after) * (new - w)
        w, t = new, after
    return w[:-1], float(w[-1])


def train(x: np.ndarray, langs: list[str]) -> Model:
    """Fit the family SVMs and, in each family, one SVM for each pair of languages."""
    names = np.array(langs)
    family = np.array([family_of(g) for g in langs])
    families = sorted(set(family.tolist()))
    members = {f: sorted(set(names[family == f].tolist())) for f in families}
    tasks = [((f"family:{a}", f"family:{b}"), family == a, family == b) for a, b in combinations(families, 2)]
    tasks += [((a, b), names == a, names == b) for f in families for a, b in combinations(members[f], 2)]
    weights, bias = np.zeros((BUCKETS, len(tasks)), np.float32), np.zeros(len(tasks))
    for i, (_, one, other) in enumerate(tasks):
        both = one | other
        weights[:, i], bias[i] = _svm(x if both.all() else x[both], np.where(one[both], 1.0, -1.0).astype(np.float32))
    return Model(families, members, [t[0] for t in tasks], weights, bias)


def fit(labelled: DataFrame, per_language: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on ``labelled``: up to ``per_language`` documents with letters of every language that it names.

    The documents are those whose ids have the smallest hashes, so the choice is the same at every run; of rows that repeat an id and a language, the least text counts. Null
    labels and ids are left out. What reaches the driver is ``per_language`` vectors a language, so it grows with the number of languages only.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    common = known.groupBy("lang").agg(F.approx_count_distinct("doc_id")).collect()  # one row a language
    # only hashes low enough for three times the wanted number reach the window, so a common language sends no more rows than a rare one
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    low = F.create_map(*(F.lit(v) for r in common for v in (r[0], min(1 << 30, (1 << 30) * 3 * per_language // r[1] + 1)))) if common else F.create_map()
    order = Window.partitionBy("lang").orderBy(draw, "doc_id")
    drawn = known.where((draw < F.try_element_at(low, F.col("lang"))) & F.col("text").rlike(r"\p{L}")) if common else known.limit(0)
    picked = drawn.select("doc_id", "lang").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("doc_id", "lang")
    least = known.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # at most per_language rows a language are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(g, features(t).astype(np.float16).tobytes()) for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.binary())], names=["lang", "x"])

    chosen = least.select("lang", "text").mapInArrow(run, "lang string, x binary")
    rows = chosen.toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    if not len(rows):
        return Model([], {}, [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float16).reshape(len(rows), BUCKETS).astype(np.float32)
    return train(x, rows["lang"].to_pylist())


def predict(docs: DataFrame, model: Model, text_col: str = "text", also: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``(*also, lang_pred, score)``, or by other ``names`` where ``also`` has columns of these: the predicted language of each whole text and a score from 0 to 1.

    ``und`` with score 0 where the text is null or has no letter. Columns besides the text and ``also`` aren't read; rows come back one for one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = also.index(text_col) if text_col in also else len(also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(also)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*also, *names])

    source = docs.select(*also) if text_col in also else docs.select(*also, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(also)])
    return source.mapInArrow(run, f"{schema}, {names[0]} string, {names[1]} double")


def held_out(id_col: str = "doc_id") -> Column:
    """True for documents whose label is never trained on: the CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
