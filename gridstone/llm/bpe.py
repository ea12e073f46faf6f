"""BPE encoding by backtracking, and decoding by an offset table.

Applying merges in rank order gives the one sequence of tokens in which every adjacent pair is *compatible*: BPE run on the two tokens' symbols
alone gives those two tokens back. So a word is encoded left to right: take the longest token that matches (from an Aho-Corasick automaton's trie), keep it if it is compatible with
the token before it, else try its next shorter prefix that is a token, and give the token before up when there
is none. A position from which no valid rest was found is marked and never tried again, so the work is linear in the word's length.

Words are encoded once for each worker while the cache lasts; the cache is bounded.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First private code point for a word's last symbol, when the vocabulary marks word ends.
_LAST = 0xE000
#: Texts of these code points are split here; others by the library's own normaliser and splitter, as Unicode versions differ.
_PLAIN = regex.compile(r"[\x00-ɏ]*")
#: What a worker keeps: so many words of at most so many characters, and so many pairs. Longer words are encoded each time.
CACHE_WORDS = 400_000
CACHE_LENGTH = 100
CACHE_PAIRS = 1_000_000


def _byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """The tokens of a BPE vocabulary in the tokenizers library's JSON format, in the order of their making, and which of them may stand side by side."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        spelt = {t: self._spell(t) for t in self.vocab}
        rank = {(a, b): i for i, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])}
        # tokens in the order of their making: symbols, then merges by rank
        made = {a + b: (a, b) for a, b in rank}
        order = sorted(self.vocab, key=lambda t: (t in made, rank[made[t]] if t in made else 0, self.vocab[t]))
        place = {t: i for i, t in enumerate(order)}
        self.ids = [self.vocab[t] for t in order]
        self.spelt = [spelt[t] for t in order]
        self.length = [len(s) for s in self.spelt]
        self.halves = [tuple(place[x] for x in made[t]) if t in made else None for t in order]
        self.joined = {(place[a], place[b]): place[a + b] for a, b in rank}
        self.trie = ahocorasick.Automaton()
        for i, s in enumerate(self.spelt):
            self.trie.add_word(s, i)
        self.trie.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}

    def _spell(self, token: str) -> str:
        """One character a symbol; the last of a word end is moved to a private range."""
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(_LAST + ord(body[-1]))
        return token

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' joint symbols gives a, b. Memoised.

        Undo the merges that made the two, the latest first: at each step, the pair that meets at the border must not have had a
        merge that would have come before the one undone last.
        """
        key = (a, b)
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        undone, good = len(self.ids), True
        left, right = a, b
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and merged < undone:
                good = False
                break
            hl, hr = self.halves[left], self.halves[right]
            if hl is None and hr is None:
                break
            if hr is None or (hl is not None and left > right):
                undone, left = left, hl[1]  # what came after this merge of the left side has been undone
            else:
                undone, right = right + 1, hr[0]  # of equal rank, the left side's merge comes first
        self.fits[key] = good
        return good


class Bpe(Merges):
    """A byte-level BPE vocabulary with a splitter of its own, read on each worker from ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        self.symbol = {chr(b): c for b, c in _byte_symbols().items()}
        self.library = Tokenizer.from_file(path)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        at = {t: i for i, t in enumerate(self.spelt)}
        self.shorter = [next((at[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in at), -1) for s in self.spelt]
        #: Ids of words as they stand in texts, and of words in byte symbols; one spelling can occur in both with other ids.
        self.cache: dict[str, tuple[int, ...]] = {}
        self.symbol_cache: dict[str, tuple[int, ...]] = {}
        self._offset_table(spec)

    def _offset_table(self, spec: dict) -> None:
        """All tokens' output bytes end to end, and where each id's begin."""
        byte = {c: b for b, c in _byte_symbols().items()}
        level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        out = [b""] * size
        for t, i in self.vocab.items():
            out[i] = bytes(byte[c] for c in t) if level else t.encode()
        for t, i in self.special.items():
            out[i] = t.encode()
        self.joint = b"" if level else b" "
        parts = [x + self.joint for x in out]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, size))))

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word, already in byte symbols, the last one moved if the vocabulary marks word ends."""
        n, trie, length = len(word), self.trie, self.length
        longest = [0] * n  # for each start, the longest token; ends come in ascending order
        for end, token in trie.iter(word):
            longest[end + 1 - length[token]] = token
        dead = bytearray(n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if not dead[end] and (not tokens or self.compatible(tokens[-1], token)):
                tokens.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead[at] = 1
                while True:  # give up the token before, and go on with a shorter one there
                    token = tokens.pop()
                    at -= length[token]
                    if self.shorter[token] >= 0:
                        token = self.shorter[token]
                        break
                    dead[at] = 1
        return tuple(self.ids[t] for t in tokens)

    def pieces(self, text: str) -> list[str]:
        """Words of text without special tokens, in the order of the text."""
        if _PLAIN.fullmatch(text):
            plain = unicodedata.normalize("NFC", text)
            return self.words.findall(plain.lower())
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _word_ids(self, word: str, symbols: bool) -> tuple[int, ...]:
        cache = self.symbol_cache if symbols else self.cache
        found = cache.get(word)
        if found is None:
            spelt = word if symbols else word.encode().decode("latin-1").translate(self._table)
            if self.suffix:
                spelt = spelt[:-1] + chr(_LAST + ord(spelt[-1]))
            found = self.encode_word(spelt)
            if len(word) <= CACHE_LENGTH:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[word] = found
        return found

    @property
    def _table(self) -> dict[int, str]:
        table = self.__dict__.get("_symbols")
        if table is None:
            table = self.__dict__["_symbols"] = {ord(k): v for k, v in self.symbol.items() if k != v}
        return table

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens in it become their ids, as the library has it by default."""
        ids: list[int] = []
        for part in self.special_pattern.split(text) if self.special_pattern else (text,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                symbols = _PLAIN.fullmatch(part) is None  # the library's splitter gives byte symbols
                cache = self.cache
                for word in self.pieces(part):
                    found = None if symbols else cache.get(word)
                    ids.extend(self._word_ids(word, symbols) if found is None else found)
        return ids

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: slices of one byte string, gathered by the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        starts = self.starts[ids]
        sizes = self.starts[ids + 1] - starts
        ends = np.cumsum(sizes)
        out = self.blob[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)].tobytes()
        return (out[: -len(self.joint)] if self.joint else out).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    """The vocabulary at ``path``, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: each whole text's ids and the text that they decode to. A null text counts as empty.

    Rows come back one for one; ids of any value and repeated rows are kept; only the two named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``encoded``, digested where the ids are made, so only digests leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                first.append(sha(" ".join(map(str, ids))))
                second.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
