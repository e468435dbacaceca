"""Token ids of texts by byte_bpe_50k: the longest tokens are taken on trust, then verified.

A text is split by the vocabulary's pattern. Of each new piece the longest token that begins it is taken again and
again (speculation). The merges would have led to the same tokens if, and only if, each token comes out of its
own bytes by the merges and each two neighbours out of their joint bytes (verification). The pairs of all
pieces of a batch are looked up at once in sorted arrays of pairs known to agree or not; only
pairs never met before are tried. Pieces with a pair that doesn't agree are merged one by one.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Pieces whose ids a worker keeps, and the longest of them in characters.
REMEMBERED, KEPT_LENGTH = 1 << 17, 64
#: Bytes of texts that are encoded together (a longer text goes alone).
AT_ONCE = 4_000_000


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.width = max(ranks.values()) + 1
        # the longest token by its first two bytes, where the search for the longest match begins
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            head = token[:2]
            self.reach[head] = max(self.reach.get(head, 1), len(token))
        self.pieces: dict[str, np.ndarray] = {}
        self.known, self.agree = np.empty(0, np.int64), np.empty(0, bool)
        self.tried = self.failed = 0

    def merged(self, piece: bytes) -> list[int]:
        """The ids by the merges themselves: the pair of the lowest rank first, of equal ones the leftmost."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at an offset
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or end[i] >= n or end[end[i]] != stop:
                continue  # one of the two parts has changed since
            gone[end[i]] = True
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (h := before[i]) >= 0 and (rank := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (rank, h, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def speculated(self, piece: bytes) -> list[int]:
        """The ids of the longest tokens from left to right."""
        ids, i, n, ranks, reach = [], 0, len(piece), self.ranks, self.reach
        while i < n:
            stop = min(n, i + reach.get(piece[i : i + 2], 1))
            while (rank := ranks.get(piece[i:stop])) is None:
                stop -= 1
            ids.append(rank)
            i = stop
        return ids

    def agreeing(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the two tokens of each pair (left * width + right) stand beside each other after the merges."""
        unique, where = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        met = np.zeros(len(unique), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] == unique
        new = unique[~met]
        if len(new):
            tokens = self.bytes_of
            found = [self.merged(tokens[a] + tokens[b]) == [a, b] for a, b in zip((new // self.width).tolist(), (new % self.width).tolist())]
            known, agree = np.concatenate([self.known, new]), np.concatenate([self.agree, np.array(found, bool)])
            order = np.argsort(known)
            self.known, self.agree = known[order], agree[order]
            at = np.searchsorted(self.known, unique)
        return self.agree[at][where]

    @functools.cached_property
    def whole(self) -> np.ndarray:
        """Whether each token comes out of its own bytes by the merges."""
        out = np.zeros(self.width, bool)
        for token, rank in self.ranks.items():
            out[rank] = len(token) == 1 or self.merged(token) == [rank]
        return out

    def encode_pieces(self, pieces: Iterable[str]) -> list[np.ndarray]:
        """The ids of each piece, all verified together."""
        raw = [piece.encode("utf-8", "replace") for piece in pieces]
        guessed = [self.speculated(piece) for piece in raw]
        sizes = np.fromiter(map(len, guessed), np.int64, len(guessed))
        flat = np.fromiter((i for ids in guessed for i in ids), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(raw)), sizes)
        bad = np.zeros(len(raw), bool)
        bad[owner[~self.whole[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inner):
            bad[owner[inner[~self.agreeing(flat[inner] * self.width + flat[inner + 1])]]] = True
        out = np.split(flat.astype(np.int32), np.cumsum(sizes)[:-1]) if raw else []
        for i in np.flatnonzero(bad).tolist():
            out[i] = np.array(self.merged(raw[i]), np.int32)
        self.tried, self.failed = self.tried + len(raw), self.failed + int(bad.sum())
        return out

    def encode_batch(self, texts: list[str | None]) -> pa.ListArray:
        split = [self.split(text) if text else [] for text in texts]
        wanted = {piece for pieces in split for piece in pieces}
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        new = [piece for piece in wanted if piece not in self.pieces]
        found = dict(zip(new, self.encode_pieces(new)))
        known = self.pieces
        rows = [[known[p] if p in known else found[p] for p in pieces] for pieces in split]
        known.update((p, ids) for p, ids in found.items() if len(p) <= KEPT_LENGTH)
        offsets = np.cumsum([0, *(sum(map(len, row)) for row in rows)])
        flat = [ids for row in rows for ids in row]
        values = np.concatenate(flat) if flat else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].as_py()


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a file of ranks with their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@functools.cache
def tokenizer(path: str | None = None) -> Bpe:
    """byte_bpe_50k, or the file of ranks at path, read once in each worker."""
    import public_tokenizers

    return Bpe(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document; a null or empty text has the empty list. Columns beside doc_id and text are not read.

    path: the vocabulary's file, at the same place on every worker; None for the installed byte_bpe_50k.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + AT_ONCE)))
                ids = bpe.encode_batch(batch.column(1).slice(start, stop - start).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), ids], names=["doc_id", "ids"])
                start = stop

    return documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")
