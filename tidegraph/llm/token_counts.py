"""Token counts of whole texts by overlap resynchronisation.

A text of up to ``chunk_chars`` code points is encoded in one call. A longer one is encoded as chunks that overlap, each
with the offsets of its tokens, and the chunks are spliced where both hold the *same token at the same place*. That place is
proven, not guessed: the merges of a score-ordered BPE give a token sequence if and only if they give every two neighbours of
it (a merge across a boundary would be the best one left for its two neighbours alone as well). In A[..i] + B[j+1..] with
A[i] = B[j] each pair of neighbours stands in A or in B, so the splice is the encoding of the joined text. Where the overlap
holds no such token it is doubled; once it reaches the start of the text, the prefix is encoded in one call and chunks grow. A splice
touches the chunks that the overlap meets, not those before them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import map_batches


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A sentencepiece processor, the code points that each id covers (continuation bytes cover none), and whether the id is a piece of
    text (bytes of one character share its offsets, so only pieces can be common to two chunks)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    width = np.zeros(sp.get_piece_size(), dtype=np.int64)
    for i in range(len(width)):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[3:5], 16)
            width[i] = 0 if 0x80 <= value < 0xC0 else 1
        elif sp.is_unknown(i):
            width[i] = -1
        else:
            width[i] = len(piece)
    piece = np.array([not (sp.is_byte(i) or sp.is_unknown(i) or sp.is_control(i)) for i in range(len(width))])
    return sp, width, piece


class OverlapCounter:
    """Counts tokens of one text after another; keeps how many chunks and widenings it took."""

    def __init__(self, path: str, chunk_chars: int = 32768, overlap_chars: int = 512):
        if not 0 < overlap_chars < chunk_chars:
            raise ValueError("overlap_chars must lie between 0 and chunk_chars")
        self.sp, self.width, self.piece = tokenizer(path)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.chunks = self.widened = 0

    def spans(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids, starts and ends (code points of the whole text) of text[start:end]; None where an id has no known width."""
        ids = np.asarray(self.sp.encode(text[start:end]), dtype=np.int64)
        width = self.width[ids]
        ends = np.cumsum(width) - 1 + start  # the first token begins with the added space
        if (width < 0).any() or (len(ids) and ends[-1] != end):
            return None
        return ids, ends - width, ends

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as one call would give them."""
        return np.concatenate([part[0] for part in self.parts(text)])

    def count(self, text: str) -> int:
        return sum(len(part[0]) for part in self.parts(text))

    def parts(self, text: str) -> list[tuple[np.ndarray, ...]]:
        """Arrays of ids, starts and ends, which one after the other encode the text (ids alone if it was encoded in one call)."""
        self.chunks, self.widened = 1, 0
        whole = lambda: [(np.asarray(self.sp.encode(text), dtype=np.int64),)]
        if len(text) <= self.chunk:
            return whole()
        chunk, done = self.chunk, self.chunk
        first = self.spans(text, 0, done)
        if first is None:
            return whole()
        kept = [first]
        while done < len(text):
            self.chunks += 1
            end, overlap, joined = min(len(text), done + chunk), self.overlap, False
            while not joined and overlap < done:
                joined = self.splice(kept, self.spans(text, done - overlap, end), done - overlap)
                if not joined:
                    self.widened += 1
                    overlap *= 2
            if not joined:
                chunk *= 2
                end = min(len(text), done + chunk)
                if (first := self.spans(text, 0, end)) is None:
                    return whole()
                kept = [first]
            done = end
        return kept

    def splice(self, kept: list[tuple[np.ndarray, ...]], b: tuple[np.ndarray, ...] | None, from_char: int) -> bool:
        """Cut kept behind the first piece that b has at the same place, and append what b has behind it; False without such a piece."""
        if b is None:
            return False
        k = len(kept) - 1
        while k and kept[k][1][0] > from_char:
            k -= 1
        a = tuple(np.concatenate(x) for x in zip(*kept[k:], strict=True))
        low = int(np.searchsorted(a[1], from_char))
        in_a = np.flatnonzero((a[2] > a[1])[low:] & self.piece[a[0][low:]]) + low
        in_b = np.flatnonzero((b[2] > b[1]) & self.piece[b[0]] & (b[1] >= from_char))
        _, i, j = np.intersect1d(a[1][in_a], b[1][in_b], assume_unique=True, return_indices=True)
        x, y = in_a[i], in_b[j]
        same = np.flatnonzero((a[0][x] == b[0][y]) & (a[2][x] == b[2][y]))
        if not len(same):
            return False
        x, y = int(x[same[0]]) + 1, int(y[same[0]]) + 1
        kept[k:] = [tuple(part[:x] for part in a)] + ([tuple(part[y:] for part in b)] if y < len(b[0]) else [])
        return True


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32768, overlap_chars: int = 512, limit: int = 4096) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit, n_chunks, n_widened.

    No shuffle; a task holds one batch. Null text counts as empty (0 tokens, 1 chunk). Null ids and repeated rows stay as
    rows of their own; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        counter = OverlapCounter(model_path, chunk_chars, overlap_chars)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = [(0, 1, 0)] * len(texts)
            short = [k for k, t in enumerate(texts) if len(t) <= chunk_chars]
            for k, ids in zip(short, counter.sp.encode([texts[k] for k in short], num_threads=1) if short else [], strict=True):
                out[k] = (len(ids), 1, 0)
            for k, t in enumerate(texts):
                if len(t) > chunk_chars:
                    out[k] = (counter.count(t), counter.chunks, counter.widened)
            n = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n[:, 0]), pa.array(n[:, 0] > limit), pa.array(n[:, 1]), pa.array(n[:, 2])],
                names=["id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
            )

    return map_batches(rows, run, "id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long").withColumnRenamed("id", id_col)
