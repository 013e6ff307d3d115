"""Packing token ids into sequences by Karmarkar-Karp multiway differencing (operator 9).

A document is its ids and an end id. Whole sequences are cut off its front; what is left of it is
cut into items, and the items of some hundred documents at a time are dealt to sequences by
differencing: partial partitions with opposing imbalances are merged until one is left, whose parts
are nearly equal. It starts from the fewest sequences that could hold the items; whenever the
largest part exceeds the capacity, one more sequence is tried.

Documents are packed where the scan reads them: no shuffle, and a task that is run again makes the
same sequences from the same rows. Give it a stored table. Null texts count as empty (only the end
id); repeated rows are packed again; an empty table gives an empty one. A very long text is encoded
whole and cut into as many sequences as it takes.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from catalog_engine.llm.common import STEP, show_library
from catalog_engine.llm.memo import Memo

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CAPACITY = 2048
END_ID = 1
#: Longest item that differencing deals out, and tokens of items that are dealt out together.
ITEM = 256
GROUP = 1 << 18
#: Parts of texts whose ids a generation keeps. Beyond the common words nearly all are met once: six times as many
#: save no time, but take 70 MB of each worker.
KEPT = 1 << 15

SCHEMA = (
    "doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


@lru_cache(maxsize=2)
def byte_encoder(path: str, ranks: str) -> Callable[[str], bytes]:
    """Encodes a text to little-endian 32-bit ids, as the tokenizers library does with ``path``.

    Between single spaces the parts of a text are encoded independently, so what a part gives is
    kept for its next use. Texts with other runs of white space around spaces, or with a special
    token, are encoded whole.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    specials = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    parts = tiktoken.Encoding(
        "parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
    )

    def packed(ids: list[int]) -> bytes:
        return pack_ids(f"<{len(ids)}I", *ids)

    #: Characters that were seen to be assigned.
    assigned: set[str] = set()

    def unassigned(part: str) -> bool:
        if assigned.issuperset(part):
            return False
        if any(category(c) == "Cn" for c in part):
            return True
        assigned.update(part)
        return False

    def make(part: str) -> bytes:
        # A part that is empty or has white space at an end would join its neighbours: b"" says so.
        if not part or part[0].isspace() or part[-1].isspace() or not part.isascii() and unassigned(part):
            return b""
        return packed(parts.encode_ordinary(" " + part))

    from struct import pack as pack_ids
    from unicodedata import category

    memo = Memo(make, KEPT)

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in specials):
            first, *rest = text.split(" ")
            found = memo.all(rest)
            if first and make(first) and b"" not in found:
                return packed(parts.encode_ordinary(first)) + b"".join(found)
        return packed(whole.encode(text, add_special_tokens=False).ids)

    return encode


def difference(lengths: list[int], parts: int) -> list[list[int]]:
    """Deals the numbers of ``lengths`` to ``parts`` lists by the largest differencing method."""
    if parts == 1:
        return [list(range(len(lengths)))]
    # The lists are chains: first and last number of each (-1: empty), and who follows on a number.
    follows = np.full(len(lengths), -1, np.int64)
    heap = []
    for i, length in enumerate(lengths):
        sums, first = np.zeros(parts, np.int64), np.full(parts, -1, np.int64)
        sums[0], first[0] = length, i
        heap.append((-length, i, sums, first, first))
    heapq.heapify(heap)
    order = len(lengths)
    while len(heap) > 1:
        _, _, a, first_a, last_a = heapq.heappop(heap)
        _, _, b, first_b, last_b = heapq.heappop(heap)
        first_b, last_b = first_b[::-1], last_b[::-1]
        # The largest part of one meets the smallest of the other.
        sums = a + b[::-1]
        rank = np.argsort(-sums, kind="stable")
        both = (first_a >= 0) & (first_b >= 0)
        follows[last_a[both]] = first_b[both]
        first = np.where(first_a >= 0, first_a, first_b)[rank]
        last = np.where(last_b >= 0, last_b, last_a)[rank]
        sums = sums[rank]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), order, sums, first, last))
        order += 1
    after = follows.tolist()
    dealt: list[list[int]] = []
    for i in heap[0][3].tolist():
        dealt.append([])
        while i >= 0:
            dealt[-1].append(i)
            i = after[i]
    return dealt


def deal(lengths: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most ``capacity``; one more is tried as long as the largest exceeds it."""
    parts = max(1, -(-sum(lengths) // capacity))
    while True:
        dealt = difference(lengths, parts)
        if all(sum(lengths[i] for i in part) <= capacity for part in dealt):
            return [part for part in dealt if part]
        parts += 1


class Packer:
    """Turns documents into pieces; ``flush`` deals out what is in hand."""

    def __init__(self, capacity: int, item: int, group: int, first_id: int):
        self.capacity, self.item, self.group, self.next = capacity, item, group, first_id
        self.items: list[tuple] = []
        self.tokens = 0
        self.docs = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        while total - start >= self.capacity:
            end = start + self.capacity
            yield doc_id, start, self.capacity, ids[4 * start : 4 * end], total, self.next, 0
            self.next += 1
            start = end
        for at in range(start, total, self.item):
            piece = ids[4 * at : 4 * min(total, at + self.item)]
            self.items.append((self.docs, at, doc_id, piece, total))
        self.tokens += total - start
        self.docs += 1
        if self.tokens >= self.group:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.items:
            return
        for part in deal([len(x[3]) // 4 for x in self.items], self.capacity):
            offset, row = 0, None
            for i in sorted(part):
                doc, at, doc_id, piece, total = self.items[i]
                if row and row[0] == doc and row[2] + len(row[3]) // 4 == at:
                    row[3] += piece  # the next item of the same document: one piece
                    continue
                if row:
                    yield self._piece(row, offset)
                    offset += len(row[3]) // 4
                row = [doc, doc_id, at, piece, total]
            yield self._piece(row, offset)
            self.next += 1
        self.items, self.tokens = [], 0

    def _piece(self, row: list, offset: int) -> tuple:
        _, doc_id, at, piece, total = row
        return doc_id, at, len(piece) // 4, piece, total, self.next, offset


def pack(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    capacity: int = CAPACITY,
    item: int = ITEM,
    group: int = GROUP,
    end_id: int = END_ID,
    path: str = BYTE_BPE,
    ranks: str = BYTE_RANKS,
) -> DataFrame:
    """One row for each piece: ``doc_id``, ``start`` (ids of its document before it), ``length``,
    ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` in it."""
    kind = docs.schema[key].dataType.simpleString()
    target = docs.sparkSession.createDataFrame([], SCHEMA.format(kind=kind)).schema
    show_library(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(target)
        encode = byte_encoder(path, ranks)
        last = np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, item, group, TaskContext.get().partitionId() << 36)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields
            )

        rows: list[tuple] = []
        for batch in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            for doc_id, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += packer.add(doc_id, encode(value or "") + last)
            if rows:
                yield table(rows)
                rows = []
        rows += packer.flush()
        if rows:
            yield table(rows)

    return docs.select(key, text).mapInArrow(run, target)
