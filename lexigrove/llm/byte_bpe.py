"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file (one base64 token and its rank a line) becomes a BPE model of the
tokenizers library: bytes are mapped to printable characters, and every split
of a token into two tokens is a merge, in the order of ranks.  Decoding turns
ids back into bytes with the reversed table, so tokens that hold a part of a
character only need no care until text is wanted.

The library keys the priority of a merge by the pair, the rank file by the
token that results, the leftmost first.  They could differ only where two
overlapping pairs, X Y and Y W, make the same token; then the left pair is listed
first (split_order()).  The tests compare the ids with those of the rank encoder.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, order_id, small_batches, text_of
from .kernels import tidy

#: Characters that are encoded in one call of the library.
CALL_CHARS = 1 << 15
#: Pieces whose ids a worker remembers.
REMEMBERED = 200_000
_CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_characters() -> list[str]:
    """The printable character of each byte: itself if it is printable Latin-1,
    else the next free one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else free))
        free += b not in printable
    return out


def split_order(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where the token can be split into two tokens, in the order of their merges.

    Of tokens X Y W with X + Y = Y + W = token the left two merge first.  That is so for
    a split at len(X) where the token has the period len(X).
    """
    splits = [k for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
    return sorted(splits, key=lambda k: (not token.startswith(token[k:]), k))


class ByteBPE:
    """One vocabulary.  Use load(), which keeps it for each worker process."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        chars = byte_characters()
        spelled = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            merges += [(spelled[token[:k]], spelled[token[k:]]) for k in split_order(token, ranks)]
        model = models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        size = max(ranks.values()) + 1
        self.table: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.table[rank] = token
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text.

        A single space between two other characters always begins a match of the
        pattern, so texts are cut there and each distinct piece is encoded once.  For the
        same reason pieces that begin with such a space can be encoded in one string.
        """
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        cut = [_CUT.split(t) for t in texts]
        new = [p for p in dict.fromkeys(itertools.chain.from_iterable(cut)) if p not in known]
        inner = [p for p in new if p.startswith(" ") and not p[-1].isspace()]
        for part in self._parts(inner):
            (whole,) = self._ids(["".join(part)])
            ends = np.cumsum(self.lengths[whole])
            at = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in part])) + 1
            for piece, own in zip(part, np.split(whole, at[:-1]), strict=True):
                known[piece] = own.tobytes()
        for part in self._parts([p for p in new if p not in known]):
            for piece, own in zip(part, self._ids(part), strict=True):
                known[piece] = own.tobytes()
        return [np.frombuffer(b"".join([known[p] for p in pieces]), "<u4") for pieces in cut]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _parts(pieces: list[str]) -> Iterator[list[str]]:
        part, chars = [], 0
        for piece in pieces:
            part.append(piece)
            chars += len(piece)
            if chars >= CALL_CHARS:
                yield part
                part, chars = [], 0
        if part:
            yield part

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes, also of tokens that are parts of a character."""
        table = self.table
        return b"".join([table[i] for i in ids.tolist()])

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in code points.

        A token inside a character starts before that character and ends after it.
        """
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        before = np.concatenate(([0], np.cumsum(lead)))  # characters that begin before each byte
        inside = np.concatenate((~lead, [False]))
        return before[starts] - inside[starts], before[ends]


@functools.lru_cache(4)
def load(rank_file: str, pattern: str) -> ByteBPE:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's to share out
    return ByteBPE(rank_file, pattern)


def _forgetting(make):
    """Workers live on: what a task has remembered goes when it ends."""

    @functools.wraps(make)
    def batches(source, rank_file: str, pattern: str, *rest):
        try:
            yield from make(source, rank_file, pattern, *rest)
        finally:
            load(rank_file, pattern).known.clear()

    return batches


@_forgetting
def _encode_batches(batches, rank_file: str, pattern: str, want_offsets: bool):
    import pyarrow as pa

    bpe = load(rank_file, pattern)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for at in _runs(texts):
            part = texts[at]
            ids = bpe.encode(part)
            columns = {
                "_id": batch.column(0).slice(at.start, len(part)),
                "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                "decoded": pa.array([bpe.decode(x) for x in ids], pa.binary()),
            }
            if want_offsets:
                spans = [bpe.offsets(t, x) for t, x in zip(part, ids, strict=True)]
                columns["starts"] = pa.array([s.astype(np.int32) for s, _ in spans], pa.list_(pa.int32()))
                columns["ends"] = pa.array([e.astype(np.int32) for _, e in spans], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)


def _runs(texts: list[str], chars: int = 1 << 19) -> Iterator[slice]:
    start, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= chars:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode(
    df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False
) -> DataFrame:
    """One row per input row: id, ids (array<int>), decoded (binary), and with
    ``offsets`` the starts and ends of the tokens in code points.

    Null or empty text has no tokens; a null id stays null; repeated rows each
    give a row; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    rows = df.select(order_id(id_col).alias("_id"), text_of(text_col).alias("_text"))
    schema = "_id long, ids array<int>, decoded binary" + ", starts array<int>, ends array<int>" * offsets
    out = rows.mapInArrow(lambda batches: _encode_batches(batches, rank_file, pattern, offsets), schema)
    return out.select(id_of(out["_id"]).alias(id_col), *[c for c in out.columns if c != "_id"])


@tidy
@_forgetting
def _token_batches(batches, rank_file: str, pattern: str):
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(1).to_pylist()
        bpe = load(rank_file, pattern)
        for at in _runs(texts):
            part = texts[at]
            ids = bpe.encode(part)
            yield pa.RecordBatch.from_pydict(
                {
                    "_id": batch.column(0).slice(at.start, len(part)),
                    "_order": batch.column(2).slice(at.start, len(part)),
                    "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                    "round_trip": [bpe.decode(x) == t.encode() for t, x in zip(part, ids, strict=True)],
                }
            )


def tokens(
    df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None
) -> DataFrame:
    """id, n_tokens, ids, and whether decoding the ids gave the text back; last ``order_col``, a
    column of whole numbers, where it is named.  Rows stay in the order that they have.

    Null or empty text has no tokens; a null id stays null; repeated rows each
    give a row; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    order = F.col(order_col).cast("long") if order_col else F.lit(None).cast("long")
    rows = df.select(order_id(id_col).alias("_id"), text_of(text_col).alias("_text"), order.alias("_order"))
    out = rows.mapInArrow(lambda batches: _token_batches(batches, rank_file, pattern), "_id long, _order long, ids array<int>, round_trip boolean")
    last = [F.col("_order").alias(order_col)] if order_col else []
    return out.select(id_of(out["_id"]).alias(id_col), F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", *last)


@tidy
def _digest_batches(batches, rank_file: str, pattern: str):
    import pyarrow as pa

    for batch in _encode_batches(batches, rank_file, pattern, False):
        ids, decoded = batch.column(1), batch.column(2)
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        yield pa.RecordBatch.from_pydict(
            {
                "_id": batch.column(0),
                "n_tokens": pa.array(np.diff(ends).astype(np.int64)),
                "ids_sha256": [
                    hashlib.sha256(flat[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)
                ],
                "decoded_sha256": [hashlib.sha256(x.as_py()).hexdigest() for x in decoded],
            }
        )


def digests(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() with its arrays reduced to counts and digests where they are made,
    so that ids and bytes need not go back to the JVM.  Nulls, repeated rows and empty
    tables as there."""
    small_batches(df.sparkSession)
    rows = df.select(order_id(id_col).alias("_id"), text_of(text_col).alias("_text"))
    out = rows.mapInArrow(
        lambda batches: _digest_batches(batches, rank_file, pattern),
        "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
    return out.select(id_of(out["_id"]).alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
