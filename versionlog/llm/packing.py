"""Best-fit packing with certified bin counts.

Documents are tokenised, cut at the capacity, and dealt into partitions.  Each partition packs best
fit, largest first.  Lower bounds by dual feasible functions certify a bin count, of a partition or of
all of them together.  While all together have a gap, partitions hand over their emptiest bins: only
the last one where the partition's own count is certified and as good as full, else as many pieces as
the next round can take.  What is handed over meets in fewer partitions and is packed anew, until the
bound is met or one partition is left.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import sliced, stored

CAPACITY = 2048
#: Pieces of a first partition, and how many partitions' leftovers meet.
PARTITION_PIECES, FAN_IN = 40_000, 16
#: Words, and pieces of words, that a worker remembers the ids of.
WORD_MEMORY, PIECE_MEMORY = 400_000, 300_000
#: Words of one text that are tokenised together.
RUN_WORDS = 50_000


#: Letters whose normalised form is one letter, and what else a plain word may hold: visible ASCII.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
#: How the pre-tokenizer cuts a plain word in lower case.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")


class WordEncoder(dict):
    """Ids (bytes of uint32) of words, for a tokenizers file whose pre-tokenizer never joins text across ASCII white space.

    The ids of a text are then those of its words in turn, and words are few, so they are remembered.
    A plain word that is new is cut into the pre-tokenizer's pieces, of which there are fewer still,
    and only new pieces go to the library; any other new word goes to it as it is.  ``splits`` tells
    whether the file has that property; texts are encoded whole if not.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.merge = self.model.model.tokenize  # for pieces that are normalised and cut already
        # The model writes each byte as one character, visible ASCII as itself; the pre-tokenizer tells the rest.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.high = {c: "".join(x for x, _ in level.pre_tokenize_str(c)) for c in map(chr, range(0xC0, 0x180))}
        self.pieces: dict[str, bytes] = {}
        probe = ["a b", "it's  so\tlong\n1 2", " x ", "\u00e9 \u0301a b", "Don't#1 \u00c9t\u00e9,x2"]
        self.splits = all(self._ids(t) == [int(i) for r in self.runs(t.encode(), True) for i in r] for t in probe)

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORD_MEMORY:
            self.clear()
        text = word.decode()
        if text.isascii() and text.isalpha():
            text = text.lower()
            out = self.pieces.get(text) or self._piece(text)
        elif _PLAIN.fullmatch(text) and "<|" not in text:
            out = b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECES.findall(text.lower())])
        else:
            out = np.array(self._ids(text), dtype=np.uint32).tobytes()
        self[word] = out
        return out

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= PIECE_MEMORY:
            self.pieces.clear()
        written = piece if piece.isascii() else "".join([self.high.get(c, c) for c in piece])
        out = self.pieces[piece] = np.array([t.id for t in self.merge(written)], dtype=np.uint32).tobytes()
        return out

    def runs(self, text: bytes, split: bool | None = None) -> Iterator[np.ndarray]:
        """The ids of a text in UTF-8, in runs of bounded length."""
        if not (self.splits if split is None else split):
            yield np.asarray(self._ids(text.decode()), dtype=np.uint32)
            return
        every = text.split()
        for at in range(0, len(every), RUN_WORDS):
            yield np.frombuffer(b"".join(map(self.__getitem__, every[at : at + RUN_WORDS])), dtype=np.uint32)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces_of(runs: Iterator[np.ndarray], capacity: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids and the end id; only what exceeds the capacity is cut."""
    piece = start = length = crc = 0
    for ids in chain(runs, [np.array([end], dtype=np.uint32)]):
        at = 0
        while at < len(ids):
            if length == capacity:
                yield piece, start, length, crc
                piece, start, length, crc = piece + 1, start + length, 0, 0
            part = ids[at : at + capacity - length]
            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
            length += len(part)
            at += len(part)
    yield piece, start, length, crc


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` of every document, each ended by the id ``end``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in sliced(it):
            ids, rows = b.column(0).to_pylist(), []
            for doc, text in zip(ids, b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                rows += [(doc, *p) for p in pieces_of(enc.runs(text or b""), capacity, end)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=b.column(0).type), *(pa.array(c, type=pa.int64()) for c in cols[1:])], names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, piece long, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that items with ``counts[size]`` (sizes 0 to capacity) need at least, by dual feasible functions.

    The volume bound; the threshold functions, which round items over capacity - t up and those under
    t away; and the stair functions u_k.  Each keeps any set of items that fits into a bin within its
    capacity, so no packing has fewer bins.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * size).sum()) // capacity)
    used = np.flatnonzero(counts)
    for t in used[used <= capacity // 2]:
        f = np.where(size > capacity - t, capacity, np.where(size < t, 0, size))
        best = max(best, -(-int((counts * f).sum()) // capacity))
    for k in range(1, 21):
        whole = (k + 1) * size % capacity == 0
        f = np.where(whole, size * k, (k + 1) * size // capacity * capacity)  # scaled by k
        best = max(best, -(-int((counts * f).sum()) // (capacity * k)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item by best fit, largest first; bins with equal room are filled in turn."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = n = 0  # bit r: a bin with room r is open
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fits = open_ >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        bins[i] = b
        if r > s:
            room[r - s].append(b)
            open_ |= 1 << (r - s)
    return bins, n


def pack_group(sizes: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, whether its bin is handed over)."""
    bins, n = best_fit(sizes, capacity)
    fill = np.bincount(bins, weights=sizes, minlength=n)
    give = np.zeros(n, dtype=bool)
    if not last and n:
        order = np.argsort(fill, kind="stable")
        # Tight: the volume alone certifies the count, and only the last bin has room worth the name.
        tight = n == -(-int(sizes.sum()) // capacity) and (n * capacity - sizes.sum()) <= (capacity - fill[order[0]]) * 1.5
        held = np.cumsum(np.bincount(bins, minlength=n)[order])
        count = 1 if tight else max(1, int(np.searchsorted(held, PARTITION_PIECES // FAN_IN, side="right")))
        give[order[:count]] = True
        give &= fill < capacity
    return bins, give[bins] if n else give[:0]


def pack(pieces_: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", report: list | None = None) -> DataFrame:
    """``pieces_`` with ``sequence_id`` and ``offset``; a sequence holds at most ``capacity`` tokens.

    Full pieces are sequences of their own.  The rest go through rounds of at most ``FAN_IN`` times
    fewer partitions; only the pieces of handed-over bins move on.  ``report`` gets each round's
    (partitions, bins so far, bound).  Repeated rows are packed as often as they occur; an empty table gives
    an empty result.
    """
    cols = [id_col, "piece", "start", "length", "ids_crc32"]
    kind = dict(pieces_.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long, __give boolean, __g long"
    full = F.col("length") == capacity
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces_.filter(~full).groupBy("length").count().collect():  # at most one row a length
        counts[r["length"]] = r["count"]
    n, bound, settled = int(counts.sum()), lower_bound(counts, capacity), 0
    groups = max(1, math.ceil(n / PARTITION_PIECES))
    # Numbers that are drawn, here and for the groups, are written down before they are used.
    done = [stored(pieces_.filter(full).select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")), "full-pieces")]
    rest = stored(pieces_.filter(~full).select(*cols, F.pmod(F.xxhash64(id_col, "piece", F.rand(7)), F.lit(groups)).alias("__g")), "pieces")
    level = 0
    while True:
        last = groups == 1

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:  # run before level and last change
            pdf = pdf.sort_values([id_col, "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
            bins, give = pack_group(pdf["length"].to_numpy(dtype=np.int64), capacity, last)
            order = np.argsort(bins, kind="stable")
            size = pdf["length"].to_numpy(dtype=np.int64)[order]
            ahead = np.cumsum(size) - size
            b = bins[order]
            begin = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, dtype=bool)
            base = np.maximum.accumulate(np.where(begin, ahead, 0)) if len(b) else ahead
            out = pdf.iloc[order].copy()
            group = int(pdf["__g"].iloc[0]) if len(pdf) else 0
            return out.assign(sequence_id=(level << 56) + (group << 24) + b, offset=ahead - base, __give=give[order])[[*cols, "sequence_id", "offset", "__give", "__g"]]

        placed = stored(rest.groupBy("__g").applyInPandas(fit, schema), f"packed-{level}")
        bins = {r["__give"]: r["n"] for r in placed.groupBy("__give").agg(F.countDistinct("sequence_id").alias("n")).collect()}
        if report is not None:
            report.append((groups, settled + sum(bins.values()), bound))
        if last or settled + sum(bins.values()) == bound:
            done.append(placed.select(*cols, "sequence_id", "offset"))
            break
        done.append(placed.filter("not __give").select(*cols, "sequence_id", "offset"))
        settled += bins.get(False, 0)
        groups = math.ceil(groups / FAN_IN)
        rest = placed.filter("__give").select(*cols, F.pmod("__g", F.lit(groups)).alias("__g"))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents packed: ``(id, piece, start, length, ids_crc32, sequence_id, offset)``.

    A null or empty text is one piece with the end id alone.
    """
    return pack(stored(pieces(docs, tokenizer, capacity, end, id_col, text_col), "all-pieces"), capacity, id_col).withColumn("piece", F.col("piece").cast("int"))
