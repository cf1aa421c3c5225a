"""Token counts by overlap resynchronisation.

Short texts are encoded whole.  A huge text is cut into chunks that overlap; each chunk is encoded
alone, its tokens get byte offsets in the normalised text, and neighbours are spliced where both
encodings have the same token on either side of one boundary.

Why that boundary is proven stable: a byte-pair encoding always applies the best-ranked merge of two
neighbouring symbols, so a token sequence is the encoding of its text exactly if every two
neighbouring tokens encode to themselves.  All neighbours inside a chunk's encoding do.  At the
splice the left and right tokens are neighbours in both chunks, so that pair does too, and the
spliced sequence is the encoding of the whole.  If an overlap has no such boundary, it is widened,
at last to the whole of the text before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from versionlog.llm.common import sliced

#: Characters of a chunk and of an overlap; longer texts than a chunk are cut.
CHUNK, OVERLAP = 32_768, 256
#: Characters encoded in one call of the library, which bounds what a call holds.
CALL_CHARS = 1_000_000
MARK = "▁"


class PieceEncoder:
    """Exact ids of a sentencepiece byte-pair model for texts of any length."""

    def __init__(self, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0
        n = self.model.get_piece_size()
        self.size = np.array([1 if self.model.is_byte(i) else len(self.model.id_to_piece(i).encode()) for i in range(n)], dtype=np.int64)
        # Chunks work on the text as the model sees it; a model that rewrites text is only used whole.
        probe = "a  b Å\t\n"
        self.plain = self.model.decode(self.model.encode(probe)) == probe and self.model.encode("") == []

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.chunk or not self.plain:
            return np.asarray(self.model.encode(text), dtype=np.int32)
        return np.concatenate(list(self.parts(text)))

    def _chunk(self, text: str, start: int, end: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the normalised characters [start, end), and the byte offsets where they begin and end.

        The library puts a mark before any text; it stands for the first character of the whole, and
        lies before ``base``, the byte offset of ``start``, elsewhere.
        """
        ids = np.asarray(self.model.encode(text[max(start - 1, 0) : end - 1]), dtype=np.int32)
        edges = np.concatenate([[0], np.cumsum(self.size[ids])]) + base - (len(MARK.encode()) if start else 0)
        return ids, edges

    @staticmethod
    def _bytes(text: str, start: int, end: int) -> int:
        """Bytes of the normalised characters [start, end)."""
        part = text[max(start - 1, 0) : max(end - 1, 0)]
        return len(part.encode()) + 2 * part.count(" ") + (len(MARK.encode()) if start == 0 < end else 0)

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """The encoding of a long text, as consecutive runs of ids."""
        total = len(text) + 1
        end = min(self.chunk, total)
        start, base = 0, 0
        ids, edges = self._chunk(text, start, end, base)
        done = 0  # tokens of the current chunk that were given out already
        while end < total:
            wide = self.overlap
            nxt = min(end + self.chunk, total)
            while True:
                at = max(end - wide, start)
                if at == start:  # nothing left to splice with: encode both chunks as one, of twice the length
                    nxt = min(max(nxt, 2 * end - start), total)
                    more, more_edges = self._chunk(text, start, nxt, base)
                    here = int(np.searchsorted(more_edges, edges[done]))
                    ids, edges, done, end = more, more_edges, here, nxt
                    break
                at_base = base + self._bytes(text, start, at)
                more, more_edges = self._chunk(text, at, nxt, at_base)
                cut = self._splice(ids, edges, more, more_edges, done, at_base)
                if cut:
                    left, right = cut
                    yield ids[done:left]
                    ids, edges, done, start, base, end = more, more_edges, right, at, at_base, nxt
                    break
                self.widened += 1
                wide *= 4
        yield ids[done:]

    @staticmethod
    def _splice(a: np.ndarray, a_edges: np.ndarray, b: np.ndarray, b_edges: np.ndarray, done: int, base: int) -> tuple[int, int] | None:
        """Token numbers (in a, in b) of a boundary with equal tokens on both sides, else None."""
        lo = max(int(np.searchsorted(a_edges, base)), done)
        inner = a_edges[lo + 1 : len(a)]  # edges with a token of a on both sides
        found = np.searchsorted(b_edges, inner)
        ok = (found > 0) & (found < len(b))
        i, j = np.arange(lo + 1, len(a))[ok], found[ok]
        ok = (b_edges[j] == a_edges[i]) & (b_edges[j - 1] == a_edges[i - 1]) & (b_edges[j + 1] == a_edges[i + 1])
        ok &= (a[i - 1] == b[j - 1]) & (a[i] == b[j])
        if not ok.any():
            return None
        k = int(np.flatnonzero(ok)[ok.sum() // 2])  # far from both ends
        return int(i[k]), int(j[k])

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(texts), dtype=np.int64)
        call: list[int] = []
        chars = 0
        for k, text in enumerate(texts):
            if len(text) > self.chunk and self.plain:
                out[k] = sum(map(len, self.parts(text)))
            elif text:
                call.append(k)
                chars += len(text)
            if call and (chars > CALL_CHARS or k == len(texts) - 1):
                out[call] = [*map(len, self.model.encode([texts[i] for i in call], num_threads=1))]
                call, chars = [], 0
        if call:
            out[call] = [*map(len, self.model.encode([texts[i] for i in call], num_threads=1))]
        return out


@lru_cache(maxsize=2)
def _encoder(model_file: str) -> PieceEncoder:
    return PieceEncoder(model_file)


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per document ``(id, n_bytes, n_tokens, over_limit)``; no shuffle, one pass over the text.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are kept as they are,
    and other columns are not read.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model_file)
        for b in sliced(it):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = enc.counts(texts)
            size = np.fromiter((len(t.encode()) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
