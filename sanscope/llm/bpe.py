"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Texts are cut by the vocabulary's pattern; every piece is encoded by a ``tokenizers`` BPE model
whose vocabulary and merges are read from a rank file (path given by the caller, resolved on the
executor). The model works on one character per byte (the byte table), so any text has an
encoding, and token boundaries may fall inside a character: offsets then give the whole character.
"""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import models

from sanscope.session import share_code

from .common import giving_back, slices

#: Pieces remembered per generation, of two; saves time only.
CACHED_PIECES = 60_000
#: Characters that are encoded together (one longer text makes a batch of its own).
BATCH_CHARS = 500_000
#: Tokens that are decoded together.
DECODE_TOKENS = 1_000_000

# The public pattern for texts without letters or numbers beyond Latin, which ``re`` reads faster
# with the same result: there every numeric character outside the second class is a decimal digit.
_LATIN_PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
                  re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""))
_NOT_LATIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from 256 upwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Pieces(dict):
    """Number of each piece; a new piece is encoded when it is first looked up.

    ``flat`` holds the ids of all pieces one after the other, ``ends`` where each piece's end.
    """

    def __init__(self, encode, old: "Pieces | None" = None):
        super().__init__()
        self.encode, self.old = encode, old
        self.flat, self.ends = array("i"), array("q")

    def ids(self, number: int) -> array:
        return self.flat[self.ends[number - 1] if number else 0 : self.ends[number]]

    def __missing__(self, piece: str) -> int:
        number = self.old.get(piece) if self.old is not None else None
        self.flat.extend(self.encode(piece) if number is None else self.old.ids(number))
        self.ends.append(len(self.flat))
        self[piece] = len(self.ends) - 1
        return len(self.ends) - 1


def read_ranks(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Decoder:
    """The bytes of each id of one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        self.n_bytes = np.zeros(top, np.int64)
        table = [b""] * top
        for t, r in ranks.items():
            table[r] = t
            self.n_bytes[r] = len(t)
        self.known = np.zeros(top, bool)
        self.known[list(ranks.values())] = True
        self.start = np.concatenate([[0], np.cumsum(self.n_bytes)[:-1]])
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a list of ids; an id outside the vocabulary is an error."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        if len(ids) > DECODE_TOKENS:
            return b"".join(self.decode(ids[k : k + DECODE_TOKENS]) for k in range(0, len(ids), DECODE_TOKENS))
        if ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("token id outside the vocabulary")
        n = self.n_bytes[ids]
        shift = self.start[ids] - np.concatenate([[0], np.cumsum(n)[:-1]])
        return self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))].tobytes()


class Codec(Decoder):
    """Encoder and decoder of one rank file; built once per task and gone with it."""

    def __init__(self, ranks_path: str, pattern: str):
        ranks = read_ranks(ranks_path)
        super().__init__(ranks)
        chars = byte_table()
        spell = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
        merges = [(spell[t[:k]], spell[t[k:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1])
                  for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.model = models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=merges)
        self.table = str.maketrans({chr(b): c for b, c in enumerate(chars)})
        self.pattern = regex.compile(pattern)
        self.fast = _LATIN_PATTERN[1] if pattern == _LATIN_PATTERN[0] else None
        self.pieces = Pieces(self.encode_piece)

    def encode_piece(self, piece: str) -> list[int]:
        spelled = piece.encode().decode("latin-1").translate(self.table)  # one character per byte
        return [t.id for t in self.model.tokenize(spelled)]

    def cut(self, text: str) -> list[str]:
        fast = self.fast is not None and not _NOT_LATIN.search(text)
        return (self.fast if fast else self.pattern).findall(text)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). Pieces met before are looked up."""
        cut = [self.cut(t) for t in texts]
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.old = None
            self.pieces = Pieces(self.encode_piece, self.pieces)
        per_text = np.array([len(c) for c in cut], np.int64)
        number = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(cut)), np.int64, int(per_text.sum()))
        ends = np.array(self.pieces.ends, np.int64)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        n = (ends - begins)[number]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = np.array(self.pieces.flat, np.int32)
        ids = flat[np.repeat(begins[number] - total[:-1], n) + np.arange(total[-1])]
        bound = np.concatenate([[0], np.cumsum(per_text)])
        return ids, np.diff(total[bound])

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        ids, n = self.encode_batch(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (exclusive) in code points of each token; a split character counts whole."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # byte -> character
        ends = np.cumsum(self.n_bytes[ids])
        return char_of[ends - self.n_bytes[ids]], char_of[ends - 1] + 1


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def token_strings(ids: list[int], ranks_path: str, pattern: str) -> list[str]:
    """The text of each token; bytes of a split character wait until the character is complete."""
    c, part = codec(ranks_path, pattern), codecs.getincrementaldecoder("utf-8")("replace")
    return [part.decode(c.decode([i]), final=k == len(ids) - 1) for k, i in enumerate(ids)]


def _with(df: DataFrame, **fields: T.DataType) -> tuple[list[str], T.StructType]:
    kept = [f for f in df.schema.fields if f.name not in fields]
    return [f.name for f in kept], T.StructType(kept + [T.StructField(n, t) for n, t in fields.items()])


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
                     offsets: bool = True) -> DataFrame:
    """All columns of ``df`` and ``token_ids`` (array of int); with ``offsets`` also ``starts`` and
    ``ends``: code points of the text, end exclusive.

    Special-token strings are ordinary text. A null or empty text has no tokens. Repeated rows are
    encoded like any others; columns named like an output column are replaced. Texts of any
    length are encoded whole; a batch is handed over after about a million tokens.
    """
    extra = {"token_ids": T.ArrayType(T.IntegerType())}
    if offsets:
        extra |= {"starts": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType())}
    names, schema = _with(df, **extra)

    def lists(flat: np.ndarray, n: np.ndarray) -> pa.Array:
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32, copy=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(ranks_path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
            at = 0
            while at < len(column):
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_CHARS, "right")))
                texts = [t or "" for t in column.slice(at, end - at).to_pylist()]
                ids, n = c.encode_batch(texts)
                cols = [batch.column(batch.schema.get_field_index(x)).slice(at, end - at) for x in names] + [lists(ids, n)]
                if offsets:
                    places = [c.offsets(t, i) for t, i in zip(texts, np.split(ids, np.cumsum(n)[:-1]))]
                    cols += [lists(np.concatenate([p[k] for p in places]), n) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *extra])
                at = end

    share_code(df.sparkSession)
    return df.mapInArrow(giving_back(run), schema)


def decode_documents(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """All columns of ``df`` but ``ids_col`` stays too, and ``decoded`` (binary): the bytes of the ids.

    A null list of ids decodes to no bytes; an id outside the vocabulary ends the job with an error.
    """
    names, schema = _with(df, decoded=T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Decoder(read_ranks(ranks_path))
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index(ids_col))
            out = [c.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64)) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(out, pa.binary())],
                names=[*names, "decoded"])

    share_code(df.sparkSession)
    return df.mapInArrow(giving_back(run), schema)
