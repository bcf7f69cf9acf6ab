"""Best-fit packing of token sequences: hierarchical residual packing.

Round 0 packs every partition on its own by best fit, longest item first. Bins that are nearly full are
done. The others become items themselves: they meet in fewer partitions, an eighth as many each round,
and are packed again until one partition is left. A round never gives a task more than `PER_TASK` items;
if that many underfull bins remain, they stay in several tasks and the rounds end when nothing is won.

Only (item id, length) pairs travel through the rounds. Each round is a written table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm.common import fresh, map_batches, stored, table, text_of

CAPACITY = 1024
SLACK = 4            # a bin with at most this much room left is done
FAN_IN = 8
PER_TASK = 200_000   # items, at 16 bytes and a few Python objects each

_BIN = "members array<bigint>, offsets array<int>, total int, done boolean"


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item positions: longest first, each into the fullest bin that has room for it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room left
    some = 0                                                   # bit r: there is a bin with room r
    bins: list[list[int]] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = some >> need
        if fitting:
            left = need + (fitting & -fitting).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
            bins[at].append(item)
        else:
            left, at = capacity, len(bins)
            bins.append([item])
        left -= need
        if left:
            room[left].append(at)
            some |= 1 << left
    return bins


def _pack(capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if taken is None:
            return
        members, offsets = taken["members"].combine_chunks(), taken["offsets"].combine_chunks()
        totals = taken["total"].to_numpy()
        bins = best_fit(totals, capacity)
        order = np.array([i for b in bins for i in b])
        inner = np.cumsum(totals[order]) - totals[order]             # place if all bins were one row
        ends = np.cumsum([len(b) for b in bins])
        begins = np.concatenate([[0], ends[:-1]])
        base = inner - np.repeat(inner[begins], ends - begins)       # place in the bin
        picked, shifted = members.take(pa.array(order)), offsets.take(pa.array(order))
        sizes = np.diff(picked.offsets.to_numpy())
        cuts = pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(sizes, begins))]).astype(np.int32))
        fill = np.add.reduceat(totals[order], begins)
        yield pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(cuts, picked.flatten()),
            pa.ListArray.from_arrays(cuts, pa.array((shifted.flatten().to_numpy() + np.repeat(base, sizes)).astype(np.int32))),
            pa.array(fill.astype(np.int32)), pa.array(fill >= capacity - slack),
        ], names=["members", "offsets", "total", "done"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """(item, length) of a stored table to (item, sequence_id, offset); lengths from 1 to `capacity`.

    An item that fills a sequence gets one of its own. The sequence takes the number of its first item. No
    items give no rows.
    """
    full = items.where(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).alias("offset"))
    left = items.where(F.col("length") < capacity).selectExpr("array(item) as members", "array(0) as offsets", "cast(length as int) as total")
    done, parts, before = [], None, None
    while True:
        bins = stored(map_batches(left, _pack(capacity, slack), _BIN))
        done.append(bins.where("done"))
        rest = bins.where("not done").drop("done")
        n = rest.count()
        fewer = max(1, -(-n // PER_TASK), (parts or 64) // fan_in)
        if n == 0 or parts == 1 or (n == before and fewer == parts):
            done.append(rest)
            break
        parts, before = fewer, n
        left = rest.repartition(parts, F.xxhash64(F.col("members")[0]))
    out = full
    for bins in done:
        out = out.unionByName(bins.select(F.col("members")[0].alias("sequence_id"), F.explode(F.arrays_zip("members", "offsets")).alias("at"))
                              .select(F.col("at.members").alias("item"), "sequence_id", F.col("at.offsets").alias("offset")))
    return out


class TokenIds:
    """Ids of a byte-level BPE tokenizer file, add_special_tokens=False.

    The file's own merges run in tiktoken, which is several times faster; its vocabulary numbers merged tokens
    in the order of the merges, so ranks are ids. Strings of added tokens are cut out first, as the file says. A
    text that tiktoken's pattern engine gives up on goes to the tokenizers library.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, file: str):
        made = json.loads(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves; others from 256 on
        char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        added = {t["content"]: t["id"] for t in made["added_tokens"]}
        ranks = {bytes(char[c] for c in token): k for token, k in made["model"]["vocab"].items() if token not in added}
        merges = [m if isinstance(m, str) else " ".join(m) for m in made["model"]["merges"]]
        numbered = [made["model"]["vocab"][m.replace(" ", "", 1)] for m in merges]
        if numbered != sorted(numbered) or made["pre_tokenizer"]["type"] != "ByteLevel" or made["normalizer"]:
            raise ValueError("not a byte-level file whose ids follow its merges")
        self._fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self._exact = Tokenizer.from_str(file)

    def __call__(self, text: str) -> list[int]:
        try:
            return self._fast.encode(text, allowed_special="all", disallowed_special=())
        except Exception:  # noqa: BLE001  its engine has a limit on backtracking
            return self._exact.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def token_ids(file: str) -> TokenIds:
    return TokenIds(file)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % capacity or capacity
    return [(0, first)] + [(k, capacity) for k in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = CAPACITY, keep_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ids): the tokens of each document and an end token, cut at `capacity`.

    A null or empty text is its end token alone. A null doc_id is carried along, repeated rows are pieces of
    their own, and an empty table has none. Texts are read whole; a document of any length is cut into full pieces
    after the first. Other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as f:
        file = f.read()
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(file)
        for batch in batches:
            rows: list[tuple] = []
            parts = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(t), end], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start:start + length]
                    rows.append((key, k, start, length, zlib.crc32(own.tobytes())))
                    if keep_ids:
                        parts.append(own.astype(np.int32))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(parts, pa.list_(pa.int32()))] * keep_ids, names=names + ["ids"] * keep_ids)

    return map_batches(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text")), run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of `token_pieces` with sequence_id and offset."""
    (item,) = fresh(docs, "item")
    pieces = stored(token_pieces(docs, tokenizer, end, capacity, keep_ids).withColumn(item, F.monotonically_increasing_id()))
    placed = pack(pieces.select(F.col(item).alias("item"), "length"), capacity)
    return pieces.join(placed.withColumnRenamed("item", item), item).drop(item).withColumn("offset", F.col("offset").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with `keep_ids`: at most `capacity` ids a row."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def op6_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
