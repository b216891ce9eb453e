"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become words joined by single spaces, so that a window of benchmark words is a byte string that begins and ends with a
space. Of m, the length of the shortest window of a class, a table over hashed 8-byte blocks gives how far a search position
may move on; only where a block can end the first m bytes of a window is its bucket opened and each window in it
compared byte by byte. Many positions of a batch move at once in numpy. The benchmark is cut into shards; the tables of each
are built once, by one task, and stored in the shared folder, from which the tasks that search read them.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import map_batches, stored

#: Word bytes stay (A-Z lower-cased); all others become spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHORT, BLOCK, BITS = 24, 8, 22
#: Benchmark text of a shard, and how many shards a worker holds.
SPLIT_BYTES, HELD = 1 << 20, 2


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return (text or "").encode().translate(TABLE).split()


class WuManber:
    """Finds all occurrences of byte patterns; patterns: distinct, each of 3 bytes at least. The bucket of a block is a run of the
    patterns sorted by the block that ends their first m bytes."""

    def __init__(self, patterns: list[bytes]):
        sizes = np.array([len(p) for p in patterns], np.int64)
        self.m = int(sizes.min())
        self.b = min(BLOCK, self.m)
        self.mask = np.uint64((1 << 8 * self.b) - 1)
        far = min(self.m - self.b + 1, 255)
        self.shift = np.full(1 << BITS, far, np.uint8)
        text = b"".join(patterns) + b"\0" * BLOCK
        view = np.ndarray((len(text) - BLOCK + 1,), "<u8", text, strides=(1,))
        starts = np.cumsum(sizes) - sizes
        for end in range(max(self.b, self.m - far), self.m + 1):  # later ends have lesser shifts
            self.shift[self.slots(view[starts + (end - self.b)] & self.mask)] = self.m - end
        suffix = view[starts + (self.m - self.b)] & self.mask
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.order, self.patterns = suffix[order], order, patterns

    @staticmethod
    def slots(blocks: np.ndarray) -> np.ndarray:
        return ((blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    def find(self, data: bytes, lane: int = 2048):
        """(position, pattern) of every occurrence in data; lanes of start positions move side by side."""
        n = len(data) - self.m + 1
        if n <= 0:
            return
        padded = data + b"\0" * BLOCK
        view = np.ndarray((len(data),), "<u8", padded, strides=(1,))
        at = np.arange(0, n, lane)
        end = np.minimum(at + lane, n)
        found = []
        while len(at):
            blocks = view[at + (self.m - self.b)] & self.mask
            step = self.shift[self.slots(blocks)]
            hit = step == 0
            if hit.any():
                found.append((at[hit], blocks[hit]))
            at = at + np.maximum(step, 1)
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        for places, blocks in found:
            first, last = np.searchsorted(self.suffix, blocks), np.searchsorted(self.suffix, blocks, "right")
            some = np.flatnonzero(first < last)
            for p, a, b in zip(places[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                for k in self.order[a:b].tolist():
                    if data.startswith(self.patterns[k], p):
                        yield p, self.patterns[k]


class Windows:
    """All windows of a set of items: short and long ones are searched apart, so that short ones do not shorten the shifts."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        self.n_words: dict[bytes, int] = {}
        for item, text in items:
            words = words_of(text)
            for k in range(max(1, len(words) - size + 1) if words else 0):
                part = words[k : k + size]
                pattern = b" " + b" ".join(part) + b" "
                self.items[pattern].add("null" if item is None else item)
                self.n_words[pattern] = len(part)
        classes = [[p for p in self.items if len(p) < SHORT], [p for p in self.items if len(p) >= SHORT]]
        self.search = [WuManber(c) for c in classes if c]


@lru_cache(maxsize=HELD)
def shard(uri: str) -> list[Windows]:
    """The tables in a file of build_shards."""
    files, path = pafs.FileSystem.from_uri(uri)
    return [pickle.loads(x.as_py()) for x in pq.read_table(path, filesystem=files)["tables"]]


def build_shards(items: DataFrame, window: int, n: int) -> list[str]:
    """URIs of Parquet files with the packed tables of n shards of items (item, text) or fewer."""

    def run(batches):
        own = [(i, t) for b in batches for i, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True)]
        made = Windows(own, window)
        if made.search:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made, protocol=5)], pa.binary())], names=["tables"])

    built = stored(map_batches(items.repartition(n), run, "tables binary"), "benchmark")
    return sorted(built.inputFiles()) if not built.isEmpty() else []


def match_batch(texts: list[str | None], shards) -> list[tuple[int, int, list[str], np.ndarray]]:
    """(n_words, n_hit, sorted items, hit words as a boolean array) of each text."""
    docs = [words_of(t) for t in texts]
    lines = [b" " + b" ".join(w) + b" " for w in docs]
    data = b"\0".join(lines)
    sizes = np.array([len(x) + 1 for x in lines])
    doc_at = np.cumsum(sizes) - sizes
    first = np.cumsum([max(1, len(w)) + 1 for w in docs]) - np.array([max(1, len(w)) + 1 for w in docs])  # spaces before each text
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    cover = np.zeros(len(spaces) + 1, np.int32)
    items: dict[int, set[str]] = defaultdict(set)
    for windows in chain.from_iterable(shards):
        for search in windows.search:
            places, patterns = [], []
            for p, pattern in search.find(data):
                places.append(p)
                patterns.append(pattern)
            owner = np.searchsorted(doc_at, places, "right") - 1
            word = np.searchsorted(spaces, places)
            for d, w, pattern in zip(owner.tolist(), word.tolist(), patterns, strict=True):
                items[d] |= windows.items[pattern]
                cover[w] += 1
                cover[w + windows.n_words[pattern]] -= 1
    covered = np.cumsum(cover)[:-1] > 0
    out = []
    for d, w in enumerate(docs):
        hit = covered[first[d] : first[d] + len(w)]
        out.append((len(w), int(hit.sum()), sorted(items.get(d, ())), hit))
    return out


def match_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, split_bytes: int = SPLIT_BYTES, whole: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, items (array), text columns unread otherwise;
    with whole, also row, a struct of all its columns.

    No shuffle of docs. The tables of the benchmark's shards, of about split_bytes of text each, are built once and read by the tasks, which
    hold HELD of them at a time; what a task reads of them for each batch grows with the benchmark, not with docs.
    Null text: no words. An item without words has no window; rows that repeat an item id add windows; a null item id
    is listed as "null". Empty tables: no rows, or no hits. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*(docs.columns if whole else [text_col])).alias("row"))
    passed = ["row"] if whole else []
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    uris = build_shards(items, window, max(1, -(-size // split_bytes)))

    def run(batches):
        for batch in batches:
            got = match_batch(batch.column("row").field(text_col).to_pylist(), map(shard, uris))
            shas = [hashlib.sha256(",".join(g[2]).encode()).hexdigest() for g in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(x, t) for x, t in (([g[0] for g in got], pa.int64()), ([g[1] for g in got], pa.int64()), ([len(g[2]) for g in got], pa.int64()), (shas, pa.string()), ([g[1] > 0 for g in got], pa.bool_()), ([g[2] for g in got], pa.list_(pa.string())))), *map(batch.column, passed)],
                names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", *passed],
            )

    schema = "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return map_batches(rows, run, schema + (f", row {rows.schema['row'].dataType.simpleString()}" if whole else "")).withColumnRenamed("id", id_col)
