"""Packing by concatenation and cutting.

First pass: each task encodes its documents once, and writes their ids with their running total within the task. Second
pass: the prefix sums of the tasks' totals are the tasks' global offsets; a document begins at offset plus running
total, and is cut where a window of the global stream ends. No document moves between tasks, and no id is encoded twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW = 2048
#: White space in a row beyond which a text goes to the library: the fast splitter's stack overflows at about a million characters.
LONG_SPACE = 100_000
_SPACES = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")  # looked for at the beginning of a run only, so in linear time
_LOADED: dict = {}


def _encoder(path: str):
    """``text -> ids`` as the tokenizers library gives them for a byte-level BPE file without normaliser and with special tokens in texts.

    The same ranks run several times as fast in tiktoken, and give the same ids; other kinds of files, and texts with very long white space, run in
    the library itself.
    """
    if path not in _LOADED:
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, level = spec["model"], spec.get("pre_tokenizer") or {}
        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        slow = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        plain = model["type"] == "BPE" and level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space") and not spec.get("normalizer") and not model.get("end_of_word_suffix") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"])
        if plain:
            import tiktoken

            from .bpe import _byte_symbols

            byte = {c: b for b, c in _byte_symbols().items()}
            ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}
            special = {x["content"]: x["id"] for x in spec["added_tokens"]}
            split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # a fixed value: the byte-level splitter's pattern
            fast = tiktoken.Encoding("words", pat_str=split, mergeable_ranks=ranks, special_tokens=special)
            _LOADED[path] = lambda text: slow(text) if len(text) >= LONG_SPACE and _SPACES.search(text) else fast.encode_to_numpy(text, allowed_special="all")
        else:
            _LOADED[path] = slow
    return _LOADED[path]


def tokens(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass, written: ``(doc_id, part, before, n, ids)``; the end id is included, and before counts ids within the task.

    ids are little-endian numbers of 16 bits if none is larger (or else of 32), so that the table stays below the texts' size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, total = _encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        for batch in batches:
            before, counts, blobs = [], [], []
            for text in batch.column(1):
                ids = np.concatenate((encode(text.as_py() or "").astype("<u4"), end))
                before.append(total)
                counts.append(len(ids))
                blobs.append(ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())
                total += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(counts), pa.int32()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "part", "before", "n", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(source.mapInArrow(run, "doc_id long, part int, before long, n long, ids binary"), "pack-ids")


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: one row per piece of a document.

    Sequences are full windows of ``window`` ids of the concatenated stream; only the last can be shorter. A document that crosses a
    boundary leaves one piece on each side. Null and empty texts have the end id only. Every row is packed, repeated rows and null ids too; an empty table
    gives no pieces. ``ids`` are little-endian unsigned 32-bit.
    """
    coded = tokens(docs, path, end_id, id_col, text_col)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task of the first pass
    base = coded.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    at = coded.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                start, wide = 0, len(ids) // n
                if wide == 2:
                    ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                while start < n:
                    sequence, offset = divmod(first + start, window)
                    length = min(n - start, window - offset)
                    rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], n, sequence, offset))
                    start += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return at.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in the ids' place."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

