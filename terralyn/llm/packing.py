"""Operator 8: documents packed into token sequences in the order of a Hilbert curve.

Each document's words give a hashed vector of few dimensions; its place on a Hilbert curve through their space is the
sort key. A document's ids are written in rows of at most LENGTH ids with that key, so a long document is many rows. A
range sort of them by key, document and start puts alike documents into neighbouring sequences; ties (copies) are dealt
on by document id, so neither a large group of copies nor a long document falls to one task. Every task cuts its run of
ids at each LENGTH; the rest of its run goes into sequences whose lengths are powers of two, which need no padding.

Ids are those of the tokenizers library for the file, without the special tokens that it adds; the strings of special
tokens in a text are special tokens for it, as the library reads them.

Cases: a null text counts as empty and is packed as its end id alone; equal ids and texts are all packed; a null
doc_id is kept; of the ids of a task, at most one unfinished sequence is held at a time.
"""

from __future__ import annotations

import functools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches_of_texts, byte_chars
from .common import U64, checkpoint, freed, shuffle_parts, utf8, word_hashes

LENGTH = 2048
DIMS, BITS = 3, 16
#: Fixed value: the pattern of byte-level vocabularies whose file asks for it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2 ** bits, one row each.

    The coordinates are turned into the curve's transposed index by undoing its reflections from the top bit down,
    then Gray-decoded; interleaving the bits gives the index.
    """
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for k in range(n):
            on = (x[k] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[k] = x[k] ^ swap
        q >>= 1
    for k in range(1, n):
        x[k] = x[k] ^ x[k - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | ((c >> b) & 1)
    return out


def curve_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The key of each document: random signs of its words, summed and scaled to its length, squashed to the grid."""
    lengths = np.diff(bounds)
    full = lengths > 0
    spread = np.zeros((len(lengths), DIMS))
    if full.any():
        signs = np.stack([1 - 2 * ((hashes >> U64(k)) & U64(1)).astype(np.int64) for k in range(DIMS)], axis=1)
        spread[full] = np.add.reduceat(signs, bounds[:-1][full], axis=0) / np.sqrt(lengths[full])[:, None]
    grid = 1 / (1 + np.exp(-np.clip(spread, -30, 30) / 4))
    return hilbert(np.minimum((grid * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """The ids that the tokenizers file gives, by tiktoken's merges where the file's ids follow the order of its merges.

    Both then merge the lowest id first, and the file's pattern is the one of byte-level vocabularies; tests compare
    the two on whole tables. Any other file is read by the tokenizers library itself.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    added = [t["content"] for t in model["added_tokens"]]

    @functools.lru_cache(maxsize=1)
    def library():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def whole(text: str) -> bytes:
        return np.array(library().encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
    vocab = model["model"]["vocab"]
    ids = [vocab.get(m.replace(" ", "", 1)) for m in merges]
    if model.get("normalizer") or model["pre_tokenizer"] != {**model["pre_tokenizer"], "type": "ByteLevel", "add_prefix_space": False} or None in ids or ids != sorted(ids):
        return whole
    import tiktoken

    back = {c: b for b, c in enumerate(byte_chars())}
    special = {t["id"] for t in model["added_tokens"]}
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if i not in special}
    engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: whole(text) if any(t in text for t in added) else np.array(engine.encode_ordinary(text), "<u4").tobytes()


def _planes(ids: bytes) -> bytes:
    """The first bytes of 32-bit ids, then their second ones, and so on: the upper ones are zeros, which compression takes away."""
    return np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes()


def _ids(planes: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encoded(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """(curve, doc_id, start, doc_tokens, ids binary): each document's place on the curve and its ids, by planes, LENGTH to a row at most."""

    def run(batches):
        encode, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc = batch.column("doc_id")
            for i, texts in batches_of_texts(batch, "text"):
                data, offsets = utf8(batch.column("text").slice(i, len(texts)))
                curve = curve_keys(*word_hashes(data, offsets))
                ids = [encode(text) + end for text in texts]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                rows = -(-sizes // LENGTH)
                own = np.repeat(np.arange(len(ids)), rows)
                start = (np.arange(len(own)) - np.repeat(np.cumsum(rows) - rows, rows)) * LENGTH
                parts = [_planes(ids[k][4 * at : 4 * (at + LENGTH)]) for k, at in zip(own.tolist(), start.tolist(), strict=True)]
                columns = [pa.array(curve[own]), doc.take(pa.array(i + own)), pa.array(start), pa.array(sizes[own]), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["curve", "doc_id", "start", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run), "curve long, doc_id long, start long, doc_tokens long, ids binary")


class _Packer:
    """Cuts one task's run of ids; holds at most one unfinished sequence."""

    def __init__(self, task: int, with_ids: bool):
        self.with_ids = with_ids
        self.next, self.held, self.fill, self.out = task << 32, [], 0, []

    def add(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(LENGTH - self.fill, len(ids) - at)
            self.held.append((doc_id, start + at, ids[at : at + n], doc_tokens))
            self.fill += n
            at += n
            if self.fill == LENGTH:
                self._close(LENGTH)

    def _close(self, length: int) -> None:
        """Takes length held ids as the next sequence."""
        at, rest = 0, []
        for doc_id, start, ids, doc_tokens in self.held:
            n = min(len(ids), length - at)
            if n:
                part = ids[:n]
                self.out.append((doc_id, start, n, zlib.crc32(part.tobytes()), doc_tokens, self.next, at, part if self.with_ids else None))
                at += n
            if n < len(ids):
                rest.append((doc_id, start + n, ids[n:], doc_tokens))
        self.held, self.next = rest, self.next + 1
        self.fill = sum(len(x[2]) for x in rest)

    def finish(self) -> None:
        while self.fill:
            self._close(1 << (self.fill.bit_length() - 1))


def pack(docs: DataFrame, path: str, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row for each piece: its document, place in it, length, CRC of the ids, and place in its sequence.

    with_ids adds the piece's ids as array<int>, which is what a writer of training sequences needs.
    """
    extra = ", ids array<int>" if with_ids else ""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        packer = _Packer(TaskContext.get().partitionId(), with_ids)

        def batch_of(rows):
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:7]]
            if with_ids:
                columns.append(pa.array([r[7].astype(np.int32) for r in rows], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, [*names, "ids"][: len(columns)])

        def flush(packer):
            if packer.out:
                yield batch_of(packer.out)
                packer.out = []

        for batch in batches:
            for doc, start, size, ids in zip(*(batch.column(c) for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                packer.add(doc.as_py(), start.as_py(), size.as_py(), _ids(ids.as_buffer()))
            yield from flush(packer)
        packer.finish()
        yield from flush(packer)

    rows = checkpoint(encoded(docs, path, end_id))  # read twice: for the splitters and for the sort
    order = ["curve", "doc_id", "start"]
    dealt = rows.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(freed(run), f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{extra}")
