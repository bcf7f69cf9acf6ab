"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1, so that pyahocorasick can hold the vocabulary. For every start position of
a piece the automaton (over reversed tokens, run over the reversed piece) names the longest token. From
there the encoder backtracks: a token may follow another only if the two are what BPE makes of their
joined bytes; that answer is memoised per pair. If nothing fits, the next shorter token is tried, then the
token before is shortened; a position found to lead nowhere is never entered again, so the work is
linear in the piece. A sequence whose tokens are pairwise compatible is exactly the result of the merges.

The vocabulary (about a megabyte) travels as bytes in the function, so executors need no file. Each
Python worker builds the automaton once. Encoded pieces are memoised up to a bound; when it is
reached the older half goes, which changes speed and nothing else.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, map_batches, table, text_of, text_ranges, wider

MEMO = 200_000   # pieces in each of the memo's two halves
CHUNK = 2_000_000  # characters encoded and handed on together
PAIRS = 500_000    # remembered token pairs


def load_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class BytePairCodec:
    """Encode and decode with a rank vocabulary; `pattern` cuts text into pieces that are merged one by one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # The rank files' own library takes Unicode's White_Space property for \s, and so do we.
        self._pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._size = {rank: len(token) for rank, token in self.bytes_of.items()}
        self._fits: dict[int, bool] = {}
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        # A token that its own merges do not produce can only stand for a whole piece.
        reached = {t: r for t, r in ranks.items() if self.merge(t) == [r]}
        self._longest = ahocorasick.Automaton()
        for token, rank in reached.items():
            self._longest.add_word(token[::-1].decode("latin-1"), rank)
        self._longest.make_automaton()
        self._shorter: dict[int, int | None] = {}
        self._reached = reached

    def merge(self, raw: bytes) -> list[int]:
        """Plain BPE: join the pair of lowest rank, leftmost first, until none is left. For short inputs."""
        parts = [raw[k:k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = self.ranks.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        fits = self._fits[left << 32 | right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return fits

    def _next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix."""
        if token not in self._shorter:
            raw = self.bytes_of[token]
            self._shorter[token] = next((self._reached[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self._reached), None)
        return self._shorter[token]

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest = [0] * n
        last = -1
        for end, rank in self._longest.iter(raw[::-1].decode("latin-1")):
            if end != last:  # the first match reported at an end is the longest
                longest[n - 1 - end] = rank
                last = end
        size, known, out, starts = self._size, self._fits.get, [], []
        dead = bytearray(n + 1)
        at, before, token = 0, -1, longest[0]
        while True:
            end = at + size[token]
            if not dead[end]:
                fits = before < 0 or known(before << 32 | token)
                if fits is None:
                    fits = self._compatible(before, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    starts.append(at)
                    at, before, token = end, token, longest[end]
                    continue
            shorter = self._next_shorter(token)
            while shorter is None:
                dead[at] = 1
                token, at = out.pop(), starts.pop()
                before = out[-1] if out else -1
                shorter = self._next_shorter(token)
            token = shorter

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as bytes; pieces used since the memo last filled up stay known."""
        out, memo, older = [], self._memo, self._older
        for piece in pieces:
            ids = memo.get(piece)
            if ids is None:
                ids = older.get(piece)
                if ids is None:
                    ids = array("i", self.encode_piece(piece.encode("utf-8"))).tobytes()
                if len(piece) < 64:
                    if len(memo) >= MEMO:
                        self._older = older = memo
                        self._memo = memo = {}
                    memo[piece] = ids
            out.append(ids)
        if len(self._fits) > PAIRS:
            self._fits.clear()
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each text); equal pieces are looked up once."""
        pieces: list[str] = []
        ends = [0]
        for text in texts:
            pieces += self._pieces(text)
            ends.append(len(pieces))
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        del pieces
        at = coded.indices.to_numpy()
        each = self._ids_of(coded.dictionary.to_pylist())
        known = np.frombuffer(b"".join(each), np.int32)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[at]
        upto = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        return known[np.repeat(starts[at] - upto[:-1], n) + np.arange(upto[-1])], np.diff(upto[np.array(ends)])

    def encode(self, text: str) -> list[int]:
        """Token ids; an empty text has none."""
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def token_bytes(vocabulary: bytes) -> pa.Array:
    """Bytes of every id; ids that the vocabulary lacks are null."""
    known = {rank: token for token, rank in load_ranks(vocabulary.splitlines()).items()}
    return pa.array([known.get(rank) for rank in range(max(known, default=-1) + 1)], pa.binary())


def decoded(ids: np.ndarray, ends: np.ndarray, tokens: pa.Array) -> pa.Array:
    """Bytes of each text, whose ids end at `ends` (0 first): the bytes of all tokens in a row, cut at the texts' ends."""
    taken = tokens.take(pa.array(ids))
    if taken.null_count:
        raise KeyError("an id that the vocabulary lacks")
    _, starts, data = taken.buffers()
    at = np.frombuffer(starts, np.int32)[taken.offset:][ends] if len(ids) else np.zeros(len(ends), np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int32)), data or pa.py_buffer(b"")])


@lru_cache(maxsize=2)
def codec(vocabulary: bytes, pattern: str) -> BytePairCodec:
    return BytePairCodec(load_ranks(vocabulary.splitlines()), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", carry: list[str] | None = None, into: str = "ids", decode_into: str | None = None) -> DataFrame:
    """The carried columns (default all) and the ids of every whole text as array<int>; with `decode_into`, also the bytes they decode to.

    A null or empty text has an empty array. Repeated rows are encoded alike; an empty table stays empty. If the
    table has a column `into`, the new one gets a trailing underscore. `vocabulary` is read on the driver.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    carry = docs.columns if carry is None else carry
    kept = docs.select(*(F.col(f"`{c}`") for c in carry))
    name, back, source = fresh(kept, into, decode_into or "decoded", "text_to_encode")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(ranks, pattern).encode_batch
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in text_ranges(texts, CHUNK):
                flat, counts = encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decode_into:
                    made.append(decoded(flat, ends, token_bytes(ranks)))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *made], names=[*batch.schema.names[:-1], name, back][:batch.num_columns - 1 + len(made)])

    made = [(name, "array<int>"), (back, "binary")][:2 if decode_into else 1]
    return map_batches(docs.select(*(F.col(f"`{c}`") for c in carry), text_of(text).alias(source)), run, wider(kept.schema, *made))


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns and the bytes that the ids stand for; null ids give null, an empty array no bytes."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    (name,) = fresh(encoded, into)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                column = batch.column(at)
                size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
                raw = decoded(column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]), token_bytes(ranks))
                raw = pc.if_else(column.is_valid(), raw, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, name])

    return map_batches(encoded, run, wider(encoded.schema, (name, "binary")))


def op1_bpe(spark, sf_dir):
    import public_tokenizers

    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = encode_documents(table(spark, sf_dir, "documents"), vocabulary, pattern, carry=["doc_id"], decode_into="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
