"""Operator 1: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut before every single space that stands between two characters that are not white space. No match of
the usual byte-level patterns crosses such a space, so the pieces can be encoded one by one and remembered; the
ids of a text are those of its pieces, one after the other. Texts need not fit in one library call.

Cases: a null text counts as empty and has no ids; rows with equal ids or texts are all returned; other columns of
the input do not matter, since only the named id and text columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

#: Pieces that a worker remembers before it starts afresh.
MEMO_LIMIT = 1_000_000

#: A space that no match crosses. Python's white space contains all that other libraries take as such.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Ends of matches inside a piece: after a letter before punctuation or a newline, and around a single newline.
_FINE = re.compile(r"(?<=[A-Za-z])(?=[.,;:!?|\n])|(?<=[.,;:!?|])(?=\n)|(?<=\S\n)(?=\S)")
#: What may be joined with others to one text: no white space at its ends, but for one space in front.
_JOINS = re.compile(r" ?\S(.*\S)?\Z", re.DOTALL)
_ODD = re.compile(r"\s | \s|^ | $")


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _from_ranks(path: str, pattern: str):
    """A tokenizers object that merges as a rank file says: the lowest rank first, by whichever pair makes it."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    chars = byte_chars()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    out = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and back."""

    def __init__(self, path: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        else:
            self.library = _from_ranks(path, pattern)
        size = self.library.get_vocab_size(with_added_tokens=True)
        back = {c: b for b, c in enumerate(byte_chars())}
        table = [b""] * size
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.memo: dict[str, bytes] = {}

    def _learn(self, pieces: list[str], glue: str) -> None:
        """Encodes pieces joined to one text, whose ids fall apart again at the pieces' ends.

        glue "": each starts with a space; a newline: none has white space at its ends.
        """
        sizes = np.array([len(p.encode()) + len(glue) for p in pieces], np.int64)
        for i, j in steps(np.concatenate([[0], np.cumsum(sizes)]), 1 << 15):
            text = "".join(p + glue for p in pieces[i:j])
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes[i:j])) + 1
            packed, at = ids.tobytes(), 0
            for p, cut in zip(pieces[i:j], (4 * cuts).tolist(), strict=True):
                self.memo[p] = packed[at : cut - 4 * len(glue)]
                at = cut

    def _add(self, new: set[str]) -> None:
        """Learns pieces from their parts: a word and its punctuation are remembered apart, so fewer go to the library."""
        parts = {p: _FINE.split(p) for p in new}
        plain, bare = [], []
        for x in set().union(*parts.values()) - self.memo.keys():
            if _JOINS.match(x):
                (plain if x[0] == " " else bare).append(x)
            else:
                self.memo[x] = np.array(self.library.encode_batch_fast([x], add_special_tokens=False)[0].ids, "<u4").tobytes()
        self._learn(plain, "")
        self._learn(bare, "\n")
        for p, own in parts.items():
            if len(own) > 1:
                self.memo[p] = b"".join(map(self.memo.__getitem__, own))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO_LIMIT:
            self.memo.clear()
        out, late, new = [], [], set()
        get = self.memo.get
        for text in texts:
            parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
            parts[1:] = map(" ".__add__, parts[1:])
            ids = list(map(get, parts))
            if None in ids:
                new.update(p for p, x in zip(parts, ids, strict=True) if x is None)
                late.append((len(out), parts))
            out.append(ids)
        if new:
            self._add(new)
            for k, parts in late:
                out[k] = map(self.memo.__getitem__, parts)
        return [b"".join(x) for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids, split characters included: bytes are joined before anything reads characters."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()

    def offsets(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one character of each id. Ids that share a split character both span it."""
        ends = np.cumsum(self.lengths[ids])
        before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        starts = ends - self.lengths[ids]
        return np.maximum(before[starts + 1] - 1, 0) if len(ids) else starts, before[ends] if len(ids) else ends


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str | None = None) -> Codec:
    return Codec(path, pattern)


def batches_of_texts(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """A batch's texts, about limit bytes at a time, with the place of the first; null is empty."""
    texts = batch.column(column)
    if not len(texts):
        return
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    for i, j in steps(size, limit):
        yield i, [x or "" for x in texts.slice(i, j - i).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str | None = None, id_column: str = "doc_id", text_column: str = "text", offsets: bool = False) -> DataFrame:
    """(id, ids array<int>) for each row, with offsets also char_start and char_end arrays of each id."""
    extra = ", char_start array<int>, char_end array<int>" if offsets else ""

    def run(batches):
        work = codec(path, pattern)
        ints = pa.list_(pa.int32())
        for batch in batches:
            for i, texts in batches_of_texts(batch, text_column):
                ids = [np.frombuffer(x, "<u4") for x in work.encode(texts)]
                columns = [batch.column(id_column).slice(i, len(texts)), pa.array([x.astype(np.int32) for x in ids], ints)]
                if offsets:
                    spans = [work.offsets(x, t.encode()) for x, t in zip(ids, texts, strict=True)]
                    columns += [pa.array([s[k].astype(np.int32) for s in spans], ints) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "ids", "char_start", "char_end"][: len(columns)])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, ids array<int>{extra}")


def decode(encoded: DataFrame, path: str, pattern: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, decoded binary) for rows of ids; a null list decodes to no bytes."""

    def run(batches):
        work = codec(path, pattern)
        for batch in batches:
            out = [work.decode(np.array(x or [], np.int64)) for x in batch.column(ids_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(out, pa.binary())], [id_column, "decoded"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, ids_column).mapInArrow(run, f"{id_column} {kind}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """Encodes each text, decodes the ids, and returns the number of ids and SHA-256 of ids and of decoded bytes.

    One pass: neither ids nor decoded bytes leave the task.
    """

    def run(batches):
        work = codec(path, pattern)
        for batch in batches:
            for i, texts in batches_of_texts(batch, "text"):
                ids = work.encode(texts)
                n = [len(x) // 4 for x in ids]
                back = (work.decode(np.frombuffer(x, "<u4")) for x in ids)
                columns = [batch.column("doc_id").slice(i, len(texts)), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
