"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut at boundaries that no piece crosses (between two characters that stand side by side in no piece), and each distinct
unit is encoded once: its substrings up to the longest piece are exploded and equi-joined to the piece table, the matches are the edges
of its lattice, grouped by unit, and the higher-order ``aggregate`` folds the Viterbi recurrence over them in order of their ends. The
path maximises the sum of the model's piece scores; of equal paths the one whose last piece begins first wins, as in the library's
unigram lattice. Characters without a piece are unknown edges (least score - 10) and become their UTF-8 bytes' pieces.

Documents are then encoded from the table of units. Tasks read it as a compact array (hash, ids) from the shared folder where it has
``max_units`` rows at most; beyond, only the most frequent max_units are read so, and documents get their other units by joins.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import map_batches, release_memory, stored

SPACE = "▁"
MAX_UNITS = 4_000_000
#: Starts of a block of a unit, and the most characters of a piece.
BLOCK = 64
#: Seed of Spark's xxhash64.
SEED = 42
UNK_PENALTY = 10.0


class Pieces:
    """The normal pieces of a model, the ids of bytes, and the cutting rules that follow from them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        self.rows = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.text = {i: p for i, p, _ in self.rows}
        self.longest = max(len(p) for p in self.text.values())
        self.unk_score = min(s for _, _, s in self.rows) - UNK_PENALTY
        self.unk_id = sp.unk_id()
        self.value = {i: b for b, i in self.bytes.items()}
        self.inside = {p[k : k + 2] for p in self.text.values() for k in range(len(p) - 1)}
        if self.longest > BLOCK:
            raise ValueError(f"a piece has more than {BLOCK} characters")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.text.values()):
            raise ValueError("a piece crosses the start of a word")
        # characters that stand first, or second, in a pair inside a piece, as rows and columns of a table of such pairs
        self.first, self.second = (np.zeros(0x110000, np.uint16) for _ in range(2))
        for side, which in ((0, self.first), (1, self.second)):
            for k, c in enumerate(sorted({pair[side] for pair in self.inside}), 1):
                which[ord(c)] = k
        self.joined = np.zeros((int(self.first.max()) + 1, int(self.second.max()) + 1), bool)
        for x, y in self.inside:
            self.joined[self.first[ord(x)], self.second[ord(y)]] = True
        raw = [" \u2047 ".encode()] * sp.get_piece_size()
        for i, t in self.text.items():
            raw[i] = t.encode()
        self.wide = np.array([len(r) for r in raw], np.int64)  # bytes of each piece as the lattice has it
        for i, t in self.text.items():
            raw[i] = t.replace(SPACE, " ").encode()
        for i, v in self.value.items():
            raw[i], self.wide[i] = bytes([v]), 1
        self.size = np.array([len(r) for r in raw], np.int64)  # and as a text has it
        self.start = np.cumsum(self.size) - self.size
        self.spelled = np.frombuffer(b"".join(raw), np.uint8)

    def units(self, word: str) -> list[str]:
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def spell(self, unit: str, ids: list[int]) -> list[int]:
        """Ids of a unit with unknown characters as bytes; checks that they spell the unit."""
        out, at = [], 0
        for i in ids:
            if i == self.unk_id:
                out += [self.bytes.get(b, i) for b in unit[at : at + 1].encode()]
                at += 1
            else:
                out.append(i)
                if not unit.startswith(self.text[i], at):
                    raise ValueError(f"the pieces of another unit were found for {unit!r}")
                at += len(self.text[i])
        if at != len(unit):
            raise ValueError(f"the pieces do not cover {unit!r}")
        return out

    def decode(self, ids) -> str:
        """The text that ids encode: pieces and bytes joined, the added space dropped."""
        raw = b"".join(bytes([self.value[i]]) if i in self.value else self.text.get(i, " ⁇ ").encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def normalised(text: str | None) -> str:
    """Spaces as the piece alphabet has them, one added in front; empty stays empty."""
    return (SPACE + text.replace(" ", SPACE)) if text else ""


def cut_units(texts: pa.StringArray, p: Pieces) -> tuple[pa.StringArray, np.ndarray]:
    """All units of an Arrow array of texts (they tile its normalised bytes), and the first unit of each text, then their number."""
    texts = pc.fill_null(texts, "")
    spaced = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar("")), " ", SPACE)
    texts = pc.if_else(pc.equal(texts, ""), texts, spaced)
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    raw = (texts.buffers()[2] or pa.py_buffer(b""))[int(at[0]) : int(at[-1])]
    at = at - at[0]
    chars = np.frombuffer(raw.to_pybytes().decode().encode("utf-32-le"), np.uint32)
    places = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    cut = np.ones(len(chars), bool)
    if len(chars):
        cut[1:] = ~p.joined[p.first[chars[:-1]], p.second[chars[1:]]]
    begin = np.searchsorted(places, at)
    cut[begin[:-1][begin[:-1] < len(chars)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(places[starts], len(raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), raw), np.searchsorted(starts, begin)


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after the other."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1]) + np.repeat(start - ends + size, size)] if len(ends) else values[:0]


def distinct_units(texts: DataFrame, model_path: str, most: int = 200_000) -> DataFrame:
    """unit, key, n: the units of texts.text, n being in how many portions of the tasks' texts they were; distinct per portion first. A unit's
    key is its text, or from BLOCK characters on its SHA-256; rows are dealt by it, so that what follows by key moves nothing, into four times
    the partitions that the session shuffles by: a unit has dozens of edges, so its bytes are no measure of what follows."""

    def run(batches):
        p = pieces_of(model_path)
        unit_table.cache_clear()  # a worker that served an earlier table holds it no longer
        done: set[str] = set()
        for batch in batches:
            units, _ = cut_units(batch.column("text"), p)
            fresh = set(units.unique().to_pylist()) - done
            if len(done) > most:
                done.clear()
            done |= fresh
            yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.string())], names=["unit"])

    lanes = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.when(F.char_length("unit") < BLOCK, F.col("unit")).otherwise(F.sha2("unit", 256))
    return map_batches(texts, run, "unit string", 1 << 20).withColumn("key", key).repartition(lanes, "key").groupBy("unit", "key").agg(F.count(F.lit(1)).alias("n"))


def encode_units(units: DataFrame, model_path: str) -> DataFrame:
    """key, hash (of the key), n, n_ids, ids of each distinct unit (unit, key, n): explode, equi-join, group, fold; all native. units must hold each unit once.

    A unit is cut into blocks of BLOCK starts with what the longest piece needs behind them, so that no row of a span carries a long unit.
    How many lengths are exploded at a start follows from its first three
    characters (no longer piece begins so). An edge is one long: end, length (the longest first) and id; scores are looked up by id.
    """
    spark = units.sparkSession
    p = pieces_of(model_path)
    # as large as the model's vocabulary; from Arrow, so that no Python worker passes them on
    table = spark.createDataFrame(pa.table({"id": pa.array([i for i, _, _ in p.rows], pa.int32()), "piece": [t for _, t, _ in p.rows]}))
    reach: dict[str, int] = {}
    for _, t, _ in p.rows:
        reach[t[:3]] = max(len(t), reach.get(t[:3], 0))
    heads = [k for k in reach if len(k) == 3]
    reaches = spark.createDataFrame(pa.table({"head": pa.array(heads, pa.string()), "reach": pa.array([reach[k] for k in heads], pa.int32())}))
    block = f"transform(sequence(0, (char_length(unit) - 1) div {BLOCK}), b -> named_struct('first', int(b * {BLOCK}), 'text', substring(unit, int(b * {BLOCK} + 1), {BLOCK + p.longest - 1})))"
    blocks = units.where("unit <> ''").select("key", "n", F.explode(F.expr(block)).alias("b")).select("key", "n", "b.first", "b.text")
    starts = blocks.select("key", "n", "first", "text", F.explode(F.sequence(F.lit(0), F.least(F.char_length("text"), F.lit(BLOCK)) - 1)).alias("start"))
    starts = starts.withColumn("head", F.substring(F.col("text"), F.col("start") + 1, F.lit(3))).join(F.broadcast(reaches), "head", "left")
    spans = starts.select("key", "n", "first", "text", "start", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("reach", F.lit(2)), F.char_length("text") - F.col("start")))).alias("len"))
    spans = spans.select("key", "n", (F.col("first") + F.col("start") + F.col("len")).alias("end"), "len", F.substring(F.col("text"), F.col("start") + 1, F.col("len")).alias("piece"))
    found = spans.join(F.broadcast(table), "piece", "left").where("id is not null or len = 1")
    edge = F.shiftleft(F.col("end").cast("long"), 32) + F.shiftleft((F.lit(255) - F.col("len")).cast("long"), 24) + F.coalesce("id", F.lit(p.unk_id))
    lattice = found.groupBy("key", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    scores = np.full(max(i for i, _, _ in p.rows) + 1, p.unk_score)
    for i, _, score in p.rows:
        scores[i] = score
    # one literal, which the optimiser makes an array
    lattice = lattice.withColumn("scores", F.split(F.lit(",".join(map(repr, scores.tolist()))), ",").cast("array<double>"))
    end, size, gain = "cast(shiftright(e, 32) as int)", "cast(255 - (shiftright(e, 24) & 255) as int)", "scores[cast(e & 16777215 as int)]"
    before = f"s.near[2 * ({end} - {size} - s.base)]"
    full = f"size(s.near) >= {4 * BLOCK}"
    away = lambda numbers: f"cast(array_join(transform({numbers}, x -> hex(cast(x as bigint) + 2147483648)), '') as binary)"
    back = lambda far: f"transform(sequence(0, length({far}) - 8, 8), i -> cast(conv(cast(substring({far}, i + 1, 8) as string), 16, 10) as bigint) - 2147483648)"
    # nodes: score and edge (size and id) of the best path to each end. near holds those from base up to the current end, exclusive, a number
    # after the other, of two blocks at most. Spark copies the state's arrays at each step, but not bytes: what lies further back
    # than any piece reaches is put away in far a block at a time, eight hexadecimal digits a number
    fold = f"""
      aggregate(edges, named_struct('far', cast('' as binary), 'near', cast(array() as array<double>), 'base', 0, 'end', 0, 'score', cast(0 as double), 'edge', cast(0 as double)),
        (s, e) -> case
          when {end} > s.end then named_struct(
            'far', case when {full} then concat(s.far, {away(f"filter(slice(s.near, 1, {2 * BLOCK}), (x, i) -> i % 2 = 1)")}) else s.far end,
            'near', array_append(array_append(case when {full} then slice(s.near, {2 * BLOCK + 1}, {2 * BLOCK}) else s.near end, s.score), s.edge),
            'base', case when {full} then s.base + {BLOCK} else s.base end,
            'end', {end}, 'score', {gain} + case when {size} = 1 then s.score else {before} end, 'edge', cast({size} * 16777216L + (e & 16777215) as double))
          when {before} + {gain} > s.score then
            named_struct('far', s.far, 'near', s.near, 'base', s.base, 'end', s.end, 'score', {before} + {gain}, 'edge', cast({size} * 16777216L + (e & 16777215) as double))
          else s end,
        s -> concat(case when s.base > 0 then {back("s.far")} else cast(array() as array<bigint>) end,
                    transform(filter(array_append(array_append(s.near, s.score), s.edge), (x, i) -> i % 2 = 1), x -> cast(x as bigint))))"""
    path = f"""
      aggregate(nodes, named_struct('at', size(nodes) - 1, 'far', cast('' as binary), 'near', cast(array() as array<int>)),
        (s, k) -> case when s.at = 0 then s else named_struct(
          'at', s.at - cast(shiftright(nodes[s.at], 24) as int),
          'far', case when {full} then concat(s.far, {away("s.near")}) else s.far end,
          'near', array_append(case when {full} then cast(array() as array<int>) else s.near end, cast(nodes[s.at] & 16777215 as int))) end,
        s -> reverse(case when length(s.far) > 0 then concat(transform({back("s.far")}, x -> cast(x as int)), s.near) else s.near end))"""
    return lattice.select("key", "n", F.expr(fold).alias("nodes")).select("key", F.xxhash64("key").alias("hash"), "n", F.expr(path).alias("ids")).select("key", "hash", "n", F.size("ids").alias("n_ids"), "ids")


def key_of(unit: str) -> str:
    return unit if len(unit) < BLOCK else hashlib.sha256(unit.encode()).hexdigest()


class UnitTable:
    """Hashes and ids of units as arrays, read from Parquet files in the shared folder: hashes and counts first, so that all arrays are made in
    their size."""

    def __init__(self, path: str, n_pieces: int):
        files, base = pafs.FileSystem.from_uri(path)
        data = pads.dataset(base, filesystem=files, format="parquet")
        batches = lambda *columns: data.to_batches(columns=list(columns), batch_size=16384, use_threads=False, batch_readahead=1, fragment_readahead=1)
        n, at = data.count_rows(), 0
        found, ends = np.empty(n, np.uint64), np.zeros(n + 1, np.int32)
        for batch in batches("hash", "n_ids"):
            found[at : at + batch.num_rows] = batch.column("hash").to_numpy().view(np.uint64)
            ends[at + 1 : at + 1 + batch.num_rows] = batch.column("n_ids").to_numpy()
            at += batch.num_rows
        np.cumsum(ends, out=ends)
        self.ids, at = np.empty(int(ends[-1]), np.uint16 if n_pieces <= 1 << 16 else np.int32), 0
        for batch in batches("ids"):
            ids = batch.column("ids").flatten().to_numpy()
            self.ids[at : at + len(ids)] = ids
            at += len(ids)
        order = np.argsort(found)
        self.hash, self.start, self.end = found[order], ends[order], ends[1:][order]
        del found, order, ends
        release_memory()

    def find(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place of each unit in the table, and whether it is there."""
        h = np.fromiter((xxhash.xxh64_intdigest(u if len(u) < BLOCK else key_of(u), SEED) for u in units), np.uint64, len(units))
        k = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        return k, self.hash[k] == h if len(self.hash) else np.zeros(len(units), bool)


@lru_cache(maxsize=1)
def unit_table(path: str, n_pieces: int) -> UnitTable:
    return UnitTable(path, n_pieces)


def encode_batch(texts: pa.StringArray, p: Pieces, table: UnitTable, rest: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and where each text's begin, then their number. Each distinct unit of the batch is looked up once, in the
    table or else in rest, its pieces are held against its bytes, and the texts' ids are gathered from these."""
    units, first = cut_units(texts, p)
    coded = units.dictionary_encode()
    own, codes = coded.dictionary, coded.indices.to_numpy()
    k, there = table.find(own.to_pylist())
    if len(table.hash):
        start, size = np.where(there, table.start[k], 0).astype(np.int64), np.where(there, table.end[k] - table.start[k], 0).astype(np.int64)
    else:
        start, size = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    pool = gathered(table.ids, start, size).astype(np.int32)
    start = np.cumsum(size) - size
    unknown = np.zeros(len(own), bool)
    unknown[np.repeat(np.arange(len(own)), size)[pool == p.unk_id]] = True
    extra, at = [pool], len(pool)
    for n in np.flatnonzero(unknown | ~there):
        unit = own[int(n)].as_py()
        got = p.spell(unit, pool[start[n] : start[n] + size[n]].tolist() if there[n] else rest[key_of(unit)])
        extra.append(np.array(got, np.int32))
        start[n], size[n] = at, len(got)
        at += len(got)
    pool = np.concatenate(extra)
    ids = gathered(pool, start, size)
    ends = np.cumsum(np.append(0, p.wide[ids]))[np.append(0, np.cumsum(size))]
    bounds = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, own.offset * 4) if len(own) else np.zeros(1, np.int32)
    if not np.array_equal(ends, bounds - bounds[0]) or spell_ids(ids, p).tobytes() != (own.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[bounds[0] : bounds[-1]].replace(SPACE.encode(), b" "):
        raise ValueError("the pieces of another unit were found")
    return gathered(pool, start[codes], size[codes]), np.append(0, np.cumsum(size[codes]))[first]


def spell_ids(ids: np.ndarray, p: Pieces) -> np.ndarray:
    return gathered(p.spelled, p.start[ids], p.size[ids])


def decode_batch(ids: np.ndarray, at: np.ndarray, p: Pieces) -> pa.StringArray:
    """The texts of ids; text k has those from at[k] to at[k + 1], and loses the space added in front."""
    ends = np.append(0, np.cumsum(p.size[ids]))[at]
    full = ends[1:] > ends[:-1]
    data = np.delete(spell_ids(ids, p), ends[:-1][full])
    ends = (ends - np.append(0, np.cumsum(full))).astype(np.int32)
    raw = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:  # ids that are no valid UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str | None = None, max_units: int = MAX_UNITS) -> DataFrame:
    """docs with a further column ids_col (array<int>), and with decoded_col (the text that the ids give) if asked for; columns of these
    names must not exist. Null and empty texts have no ids;
    repeated rows get equal ids; an empty table gives no rows; all other columns stay as they are."""
    if clash := {ids_col, decoded_col} & set(docs.columns):
        raise ValueError(f"columns exist: {clash}")
    texts = docs.select(F.col(text_col).alias("text"))
    table = stored(encode_units(distinct_units(texts, model_path), model_path), "units")
    n = table.count()
    head = table if n <= max_units else stored(table.orderBy(F.desc("n"), "key").limit(max_units), "head-units")
    path = head.inputFiles()[0].rpartition("/")[0] if n else None
    fields, key = docs.columns, "_lattice_key"
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"f{k}") for k, c in enumerate(fields)]).alias("row"), F.xxhash64(F.col(text_col)).alias(key))
    place = f"f{fields.index(text_col)}"  # of the text in a row: it is sent once
    if n > max_units:

        def tail(batches):
            p = pieces_of(model_path)
            seen = unit_table(path, len(p.size))
            for batch in batches:
                units, first = cut_units(batch.column("text"), p)
                coded = units.dictionary_encode()
                lacking = ~seen.find(coded.dictionary.to_pylist())[1]
                places = np.flatnonzero(lacking[coded.indices.to_numpy()])
                owners = batch.column(key).take(pa.array(np.searchsorted(first, places, "right") - 1))
                got = pa.RecordBatch.from_arrays([owners, pa.array(map(key_of, units.take(pa.array(places)).to_pylist()), pa.string())], names=[key, "key"])
                yield pa.Table.from_batches([got]).group_by([key, "key"]).aggregate([]).select([key, "key"]).combine_chunks().to_batches()[0] if len(places) else got

        needs = map_batches(rows.select(key, F.col(f"row.{place}").alias("text")), tail, f"{key} long, key string").distinct().join(table.select("key", "ids"), "key")
        rest = needs.groupBy(key).agg(F.collect_list(F.struct("key", "ids")).alias("rest"))
        rows = rows.join(rest, key, "left")
    else:
        rows = rows.withColumn("rest", F.lit(None).cast("array<struct<key:string,ids:array<int>>>"))

    def run(batches):
        p = pieces_of(model_path)
        for batch in batches:
            rest = {r["key"]: r["ids"] for x in batch.column("rest").drop_null().to_pylist() for r in x}
            texts = batch.column("row").field(place)
            ids, at = encode_batch(texts, p, unit_table(path, len(p.size)), rest) if path else (np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64))
            decoded = pa.nulls(len(texts), pa.string())
            if decoded_col:
                decoded = pc.if_else(pc.is_valid(texts), decode_batch(ids, at, p), decoded)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), decoded], names=["row", "ids", "decoded"])

    kept = rows.select("row", "rest")
    out = map_batches(kept, run, f"row {kept.schema['row'].dataType.simpleString()}, ids array<int>, decoded string", 1 << 20)
    more = [F.col("decoded").alias(decoded_col)] if decoded_col else []
    return out.select(*[F.col("row")[f"f{k}"].alias(c) for k, c in enumerate(fields)], F.col("ids").alias(ids_col), *more)


def decode_ids(encoded: DataFrame, model_path: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """encoded with a further column text_col: the texts of the ids. Null ids decode to null, no ids to the empty text."""

    @F.pandas_udf("string")
    def decoded(col):
        p = pieces_of(model_path)
        return col.map(lambda ids: None if ids is None else p.decode([int(i) for i in ids]))

    return encoded.withColumn(text_col, decoded(F.col(ids_col)))
