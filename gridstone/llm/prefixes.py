"""Token counts at every prefix, by dynamic programming over prefixes.

In byte-level BPE every prefix of a word has one last token: of the tokens that end there, the only one that is compatible with the
last token of what is left before it. So ``count[i] = count[i - length of that token] + 1``, one pass over an Aho-Corasick
automaton's matches gives the counts of all prefixes of a word, and sums over words those of all prefixes of a text. The counts are kept as
steps from prefix to prefix; how many tokens the first n characters have, or how many characters fit a budget, is read off them without encoding again.

A prefix counts as the library would count it on its own, wherever the cut is: inside a run of white space (whose last character otherwise belongs to the next
word), a contraction, or the string of a special token.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _PLAIN, CACHE_LENGTH, CACHE_PAIRS, CACHE_WORDS, Merges, _byte_symbols

#: The splitter of byte-level vocabularies, and its contractions of which a prefix splits in two.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


class _ByteMerges(Merges):
    """Tokens spelt as their bytes, one character each, so that words need no translation."""

    _byte = {c: chr(b) for b, c in _byte_symbols().items()}

    def _spell(self, token: str) -> str:
        return "".join(map(self._byte.__getitem__, token))


class _Words(dict):
    """Counts of a word's prefixes, one for each character, as little-endian numbers of 32 bits; words of moderate length are kept."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges
        self.fits: dict[int, bool] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.counts(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found

    def counts(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1")
        n, length, fits = len(spelt), self.merges.length, self.fits
        last, count = [0] * (n + 1), [0] * (n + 1)
        for end, token in self.merges.trie.iter(spelt):
            end += 1
            if count[end]:
                continue
            before = end - length[token]
            if before:
                pair = last[before] << 24 | token
                good = fits.get(pair)
                if good is None:
                    if len(fits) >= CACHE_PAIRS:
                        fits.clear()
                    good = fits[pair] = self.merges.compatible(last[before], token)
                if not good:
                    continue
            last[end], count[end] = token, count[before] + 1
        del count[0]
        if word in LONG_CONTRACTIONS:
            count[1] = 2
        found = array("I", count)
        if sys.byteorder == "big":
            found.byteswap()
        if spelt is word:
            return found.tobytes()
        follows = np.frombuffer(spelt.encode("latin-1"), np.uint8) & 0xC0 == 0x80
        return np.frombuffer(found.tobytes(), "<u4")[np.append(~follows[1:], True)].tobytes()  # at the last byte of each character


class PrefixCounts:
    """Counts for a byte-level BPE file of the tokenizers library without normaliser, as ``Tokenizer.encode(text, add_special_tokens=False)`` has them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        level = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = spec["model"]["type"] == "BPE" and level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("end_of_word_suffix") and not spec["model"].get("ignore_merges")
        if not plain or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.words, self.split = _Words(_ByteMerges(spec)), regex.compile(SPLIT)
        self.runs = regex.compile(r"(?<!\s)\s{2,}+(?=\S)")
        self.library = Tokenizer.from_file(path).pre_tokenizer
        special = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _words(self, text: str) -> list[str]:
        """Words; by the library where a text leaves the range in which Unicode versions agree on letters."""
        if _PLAIN.fullmatch(text):
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _ordinary(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text without special tokens."""
        if not text:
            return np.empty(0, np.int64)
        words = self._words(text)
        found = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        total = np.cumsum(found[np.cumsum(sizes) - 1])
        found[sizes[0] :] += np.repeat(total[:-1], sizes[1:])
        for a, b in (m.span() for m in self.runs.finditer(text)):
            found[b - 1] = (found[a - 1] if a else 0) + np.frombuffer(self.words[text[a:b]][-4:], "<u4")[0]
        return found

    def counts(self, text: str) -> np.ndarray:
        """The number of tokens of ``text[:n]`` for n from 1 to its length."""
        out, base, at = [], 0, 0
        for m in self.special.finditer(text) if self.special else ():
            begin, end = m.span()
            ordinary = self._ordinary(text[at : end - 1])  # a prefix that cuts the special token is ordinary text
            whole = (ordinary[begin - at - 1] if begin > at else 0) + 1
            out += [ordinary + base, np.array([whole + base])]
            base, at = base + whole, end
        return np.concatenate([*out, self._ordinary(text[at:]) + base])


_LOADED: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    """The vocabulary at ``path``, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounts(path)
    return _LOADED[path]


def _steps(counts: np.ndarray) -> bytes:
    """Steps between neighbouring counts, in the least of 1, 2 and 4 bytes that holds all of them."""
    step = np.diff(counts, prepend=0)
    return step.astype(next(t for t in ("<i1", "<i2", "<i4") if not len(step) or np.array_equal(step.astype(t), step))).tobytes()


def _counts(steps: bytes, chars: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, f"<i{len(steps) // chars}"), dtype=np.int64) if chars else np.empty(0, np.int64)


def _longest(counts: np.ndarray, budget: int) -> int:
    """The most characters that a prefix of at most ``budget`` tokens has. Counts can fall where a longer token completes, so the last such prefix is meant."""
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, n_bytes, n_tokens, steps)``: each whole text's counts at every prefix, to be written once and asked often.

    A null text counts as empty: no characters, no tokens, no steps. Rows come one for one, repeated rows and null ids too; other columns are not read. An empty
    table gives an empty one. Nothing is shuffled; a worker holds one text's counts at a time, and words and pairs up to fixed numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                counts = prefixes.counts(text)
                rows.append((len(text), len(text.encode()), int(counts[-1]) if text else 0, _steps(counts)))
            chars, size, n, steps = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(steps, pa.binary())], names=["doc_id", "n_chars", "n_bytes", "n_tokens", "steps"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_chars long, n_bytes long, n_tokens long, steps binary")


def _asked(table: DataFrame, name: str, answer) -> DataFrame:
    """``table`` without its steps, and with ``answer(counts)`` under ``name``."""
    kept = [c for c in table.columns if c != "steps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [answer(_counts(s.as_py(), n.as_py())) for s, n in zip(batch.column("steps"), batch.column("n_chars"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.int64())], names=[*kept, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != "steps")
    return table.mapInArrow(run, f"{schema}, `{name}` long")


def tokens_at(table: DataFrame, chars: int) -> DataFrame:
    """A prefix table with ``tokens_at``: the tokens of each text's first ``chars`` characters (of all, where it has fewer)."""
    return _asked(table, "tokens_at", lambda counts: int(counts[min(chars, len(counts)) - 1]) if chars > 0 and len(counts) else 0)


def chars_within(table: DataFrame, budget: int) -> DataFrame:
    """A prefix table with ``chars_within``: where to cut each text so that at most ``budget`` tokens stay, and as many characters as can."""
    return _asked(table, "chars_within", lambda counts: _longest(counts, budget))


def counted(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, n_chars, chars_within)`` of every whole text: whether it has more than ``limit`` tokens, and where to cut it so that it has not."""
    asked = chars_within(prefix_table(docs, path, id_col, text_col), limit)
    return asked.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chars", "chars_within")
