"""Exact n-gram Jaccard self-join by a token-group matrix.

1. Texts become sets of word shingles (64-bit hashes); equal sets are one node. A node is named by a 64-bit hash of its set: of n distinct
   sets n^2/2^65 pairs are expected to share a name.
2. Nodes are partitioned into groups of similar ones: bands of minhashes propose a pivot p for each node, and a node whose similarity to it
   is NEAR percent at least is in p's group. Whole texts give the node's delta to p: the tokens that it adds (B) and those of p that it lacks (A).
3. Within a group no texts are compared pair by pair. With A_x = |A| and B_x = |B| of x, |x & y| = |p| - A_x - A_y + |delta x & delta y|, so x and y
   link where their deltas share K(x, y) = (S_x + S_y - T) / M tokens or more, with S = 100 A + percent B, T = (100 - percent) |p|,
   M = 100 + percent. x links to p itself where S_x <= T; two such nodes are linked through p. If x is loose (S_x > T), K is positive for any
   y: it exceeds (S_x - T) / M, and S_x / M if y is loose as well (then S_y / M too). So a prefix of each delta, the group's rare tokens first, finds
   all pairs, which whole texts then decide. A family of texts below the threshold, whose deltas are its members' own words, has few.
4. The token-group matrix holds, for each group, the union of its members' prefix tokens, with the least and greatest set size. Prefix:
   under a total order of tokens, the first |q| - ceil(t|q|) + e(|q|) of a set, e(n) = max(1, 15 n / 100). A partner x shares
   min(e(|q|), e(|x|)) prefix tokens with q at least, and |x| >= ceil(t|q|), so only groups whose union holds e(ceil(t|q|)) of q's prefix
   tokens, and whose sizes fit, can hold one. Any total order is right; ours has last what a counting sketch of all tokens
   finds more often than chance, so that shared passages and boilerplate open few groups: a token among the first is in some
   6 sqrt(N / 2^22) sets of N tokens at most, and the rows that it brings about grow in proportion to N.
5. A query opens the qualifying groups other than its own as a guest: its delta to their pivot is taken, and 3 holds for it and the members.
6. Components: smallest label over links, with pointer jumping; all state in tables of the shared folder.

Nothing is sampled or capped: links between different texts are found through 3 or 5, or join two nodes linked to one pivot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import map_batches, stored

BANDS, ROWS = 8, 3
#: Counters of the token sketch, and of each part of it that a row holds.
WIDTH, PART = 1 << 22, 1 << 16
#: Ids to which a broadcast is limited (8 bytes each); above, Spark joins by shuffle.
BROADCAST_IDS = 1 << 20
#: Percent of its size by which a set's prefix is longer than the least one, and that it shares there with a partner.
EXTRA = 15
#: Percent of similarity to its pivot from which a node is in the pivot's group. Any value gives the same links.
NEAR = 40
BATCH = 4 << 20
_rng = np.random.default_rng(20240229)
MIX = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BYTE[SPACE] = 0
EDGES = np.array([k * (1 << 64) // (BANDS * ROWS) for k in range(BANDS * ROWS)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words [^\x20\x09-\x0D]+ (A-Z lower-cased) of an Arrow array, and the first word of each text, then their
    number. A word's hash sums its bytes' random values times those of their places, so it is taken from the buffer in one sweep."""
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    gap = SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    before[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(before & ~gap)
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    sizes = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
    values = BYTE[data[starts[0] :]] * PLACE[place & 1023]
    if sizes.max() > 1024:
        values *= (place >> 10).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return mixed(np.add.reduceat(values, starts - starts[0])), first


def shingle_sets(texts: pa.StringArray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a text of fewer words has one shingle of all, one without words none."""
    h, first = word_hashes(texts)
    k = len(h) - size + 1
    rolled = mixed(sum(h[i : k + i] * MIX[i % 16] for i in range(size))) if k > 0 else h[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a < size:
            out.append(mixed(np.array([(h[a:b] * MIX[[i % 16 for i in range(b - a)]]).sum() + np.uint64(b - a)], np.uint64)) if b > a else h[:0])
            continue
        s = np.sort(rolled[a : b - size + 1])
        keep = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=keep[1:])
        out.append(s if keep.all() else s[keep])
    return out


def name_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(xxhash.xxh3_64_intdigest(s.tobytes())) - (1 << 63)


def bands_of(s: np.ndarray) -> list[int]:
    """Keys of the bands of a one-permutation minhash: of each slice of the hash range the first token, or the next one around."""
    low = s[np.searchsorted(s, EDGES) % len(s)].reshape(BANDS, ROWS)
    return [int(xxhash.xxh3_64_intdigest(low[b].tobytes(), seed=b)) - (1 << 63) for b in range(BANDS)]


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n tokens with a partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def spare(n: int, percent: int) -> int:
    """How many prefix tokens a set of n shares at least with any partner not smaller."""
    return max(1, n * EXTRA // 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """id, n, name, bands of each row; at its end each task adds rows with the parts of its token sketch (part, counts)."""
    names = ["id", "n", "name", "bands", "part", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def run(batches):
        sketch = np.zeros(WIDTH, np.int64)
        for batch in batches:
            sets = shingle_sets(batch.column("text"), size)
            sketch += np.bincount(counter_of(np.concatenate(sets)), minlength=WIDTH)
            k = len(sets)
            columns = [batch.column("id"), [len(s) for s in sets], [name_of(s) if len(s) else None for s in sets], [bands_of(s) if len(s) else [] for s in sets], [None] * k, [None] * k]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        parts = [k for k in range(WIDTH // PART) if sketch[k * PART : (k + 1) * PART].any()]
        for k in parts:
            data = sketch[k * PART : (k + 1) * PART].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, k, data), types, strict=True)], names=names)

    return map_batches(rows, run, "id long, n long, name long, bands array<long>, part int, counts binary", BATCH)


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return ((tokens * MIX[9]) >> np.uint64(42)).astype(np.int64)


def token_classes(sketches: DataFrame) -> np.ndarray:
    """Of each counter of the summed sketch (all tokens of all rows) a class: 0 up to chance, else by its magnitude. Tasks add up the
    rows of a part as they stream; the driver gets WIDTH bytes."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(data, "<i4").astype(np.int64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "sums"])

    summed = stored(map_batches(sketches.repartition(WIDTH // PART, "part"), run, "part int, sums binary"), "sketch")
    total = summed.select(F.col("part")).count()
    if not total:
        return np.zeros(WIDTH, np.uint8)
    counts = np.zeros(WIDTH, np.int64)
    for row in summed.toLocalIterator():
        counts[row.part * PART : (row.part + 1) * PART] = np.frombuffer(row.sums, np.int64)
    mean = counts.mean()
    over = counts - mean
    return np.where(over > 6 * np.sqrt(mean) + 4, 1 + 4 * np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


class Seen(set):
    """Names that a task has met, emptied when they are many: copies met again need not be sent again."""

    def new(self, name: int) -> bool:
        if name in self:
            return False
        if len(self) >= 500_000:
            self.clear()
        self.add(name)
        return True


def prefixes(rows: DataFrame, size: int, percent: int, classes: np.ndarray) -> DataFrame:
    """token, name for the prefix tokens of each set, under the order by class, then token."""

    def run(batches):
        seen = Seen()
        for batch in batches:
            names, parts = [], []
            for s in shingle_sets(batch.column("text"), size):
                if not len(s) or not seen.new(name := name_of(s)):
                    continue
                p = len(s) - needed(len(s), percent) + spare(len(s), percent)
                kind = classes[counter_of(s)]
                first = s[kind == 0][:p]
                if len(first) < p:
                    rest = np.flatnonzero(kind)
                    first = np.concatenate([first, s[rest[np.lexsort((s[rest], kind[rest]))[: p - len(first)]]]])
                names.append(name)
                parts.append(first)
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), [len(x) for x in parts]))], names=["token", "name"])

    return map_batches(rows, run, "token long, name long", BATCH)


def named_texts(rows: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """name, text of one document of each of the names."""

    def run(batches):
        seen = Seen()
        for batch in batches:
            got = [name_of(s) if len(s) else None for s in shingle_sets(batch.column("text"), size)]
            keep = [k for k, name in enumerate(got) if name is not None and seen.new(name)]
            yield pa.RecordBatch.from_arrays([pa.array([got[k] for k in keep], pa.int64()), batch.column("text").take(pa.array(keep, pa.int64()))], names=["name", "text"])

    few = names.count() <= BROADCAST_IDS
    return map_batches(rows, run, "name long, text string", BATCH).join(F.broadcast(names) if few else names, "name", "left_semi").dropDuplicates(["name"])


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough. A text that many pairs share is met in a join that Spark may split."""
    left = pairs.join(texts.select(F.col("name").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("name").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            sets = zip(shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size), strict=True)
            ok = pa.array([similar(a, b, percent) for a, b in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return map_batches(both.select("a", "b", "text_a", "text_b"), run, "a long, b long", BATCH)


def delta(x: np.ndarray, p: np.ndarray, percent: int) -> tuple[bool, bool, np.ndarray, int, int]:
    """Whether x links to p, whether it is near p, its delta to p (missing tokens inverted), and how long a prefix of this, in any order
    that all members share, holds for a loose partner and for any."""
    added, missing = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
    cost, free, per = 100 * len(missing) + percent * len(added), (100 - percent) * len(p), 100 + percent
    both = len(added) + len(missing)
    short = max(0, both - (cost // per + 1) + 1)
    whole = short if cost <= free else both + (free - cost) // per + 1
    return cost <= free, 100 * (len(x) - len(added)) >= NEAR * (len(p) + len(added)), np.concatenate([added, ~missing]), short, whole


def deltas(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, n (of a), linked, near, short, whole, p (size of b), tokens: the delta of each a to the pivot b."""
    left = pairs.join(texts.select(F.col("name").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("name").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            names = batch.column("b").to_pylist()
            firsts = {name: k for k, name in reversed(list(enumerate(names)))}
            pivots = dict(zip(firsts, shingle_sets(batch.column("text_b").take(pa.array(list(firsts.values()))), size), strict=True))
            sets = shingle_sets(batch.column("text_a"), size)
            got = [delta(x, pivots[name], percent) for x, name in zip(sets, names, strict=True)]
            ends = np.cumsum([0, *(len(g[2]) for g in got)])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([g[2] for g in got]).view(np.int64)))
            columns = [batch.column("a"), batch.column("b"), pa.array([len(x) for x in sets], pa.int64()), pa.array([bool(g[0]) for g in got]), pa.array([bool(g[1]) for g in got]), pa.array([g[3] for g in got], pa.int32()), pa.array([g[4] for g in got], pa.int32()), pa.array([len(pivots[name]) for name in names], pa.int32()), tokens]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "linked", "near", "short", "whole", "p", "tokens"])

    return map_batches(both.select("a", "b", "text_a", "text_b"), run, "a long, b long, n long, linked boolean, near boolean, short int, whole int, p int, tokens array<long>", BATCH)


def within_groups(hosts: DataFrame, guests: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of a group's members, and of a guest and a member, that may link by their deltas; two that link to the pivot are left out."""

    def spread(d: DataFrame, guest: bool) -> DataFrame:
        return d.select("a", "b", F.lit(guest).alias("guest"), "n", "p", "linked", "short", "whole", F.size("tokens").alias("total"), F.explode("tokens").alias("token"))

    every = spread(hosts, False).union(spread(guests.join(hosts.select("b").distinct(), "b", "left_semi"), True))
    # the rarest of the group come first; a token that one delta alone has matches nothing, so it only moves the others back
    often = every.groupBy("b", "token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    own = Window.partitionBy("a", "b", "guest")
    rank = F.row_number().over(own.orderBy("k", "token"))
    kept = every.join(often, ["b", "token"]).withColumn("rank", rank).withColumn("place", F.col("total") - F.count(F.lit(1)).over(own) + F.col("rank")).where("place <= whole")
    kept = stored(kept.select("a", "b", "guest", "n", "p", "linked", "total", "rank", "place", "token", (F.col("place") <= F.col("short")).alias("first")), "delta-prefixes")
    members, visitors = kept.where("not guest"), kept.where("guest")
    right = members.select("b", "token", F.col("a").alias("a2"), F.col("n").alias("n2"), F.col("linked").alias("linked2"), F.col("first").alias("first2"), F.col("total").alias("total2"), F.col("rank").alias("rank2"), F.col("place").alias("place2"))
    lacks = lambda n, total: (F.col(total) + F.col("p") - F.col(n)) / 2
    cost = lambda n, total: lacks(n, total) * (100 - percent) + F.col(total) * percent
    reaches = lambda common: common * (100 + percent) >= cost("n", "total") + cost("n2", "total2") - (100 - percent) * F.col("p")
    # up to a common token two deltas share no more than its lesser rank, behind it no more than the shorter rest: both must reach K
    most = F.least("rank", "rank2") + F.least(F.col("total") - F.col("place"), F.col("total2") - F.col("place2"))
    fits = (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent) & (F.col("a") != F.col("a2")) & reaches(most)
    once = F.col("linked2") | (F.col("first") & F.col("first2") & (F.col("guest") | (F.col("a") < F.col("a2"))))
    loose = kept.where("not linked").join(right, ["b", "token"]).where(fits & once)
    linked = visitors.where("linked").join(right.where("not linked2"), ["b", "token"]).where(fits)
    # and all in all what their prefixes share, and at most what stands behind the last of it
    met = loose.union(linked).groupBy("a", "a2", "b", "n", "n2", "p", "total", "total2").agg(
        F.count(F.lit(1)).alias("common"), F.max("place").alias("last"), F.max("place2").alias("last2"))
    most = F.col("common") + F.least(F.col("total") - F.col("last"), F.col("total2") - F.col("last2"))
    return met.where(reaches(most)).select("a", F.col("a2").alias("b")).distinct()


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """name, root, least: of each linked node a name for its component, and the smallest id over all nodes that links reach. nodes: name, id; links: a, b.

    Each round: a node takes the smallest root among its neighbours' and its own, hangs that root under it, then jumps to its root's root.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    linked = both.select(F.col("a").alias("name")).distinct()
    state = stored(linked.select("name", F.col("name").alias("root")), "roots")
    for _ in range(max_rounds):
        near = both.join(state.select(F.col("name").alias("b"), "root"), "b").groupBy(F.col("a").alias("name")).agg(F.min("root").alias("near"))
        seen = state.join(near, "name").select("name", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hung = seen.groupBy(F.col("old").alias("name")).agg(F.min("root").alias("under"))
        step = seen.join(hung, "name", "left").select("name", "old", F.least("root", F.coalesce("under", "root")).alias("root"))
        jump = step.join(step.select(F.col("name").alias("root"), F.col("root").alias("next")), "root", "left")
        state = stored(jump.select("name", "old", F.least("root", F.coalesce("next", "root")).alias("root")), "roots")
        if state.where("old <> root").isEmpty():
            break
    else:
        raise RuntimeError(f"components do not settle within {max_rounds} rounds")
    least = state.join(nodes, "name").groupBy("root").agg(F.min("id").alias("least"))
    return state.join(least, "root").select("name", "root", "least")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id that links reach, its own included).

    Two rows link where 100 * |intersection| >= percent * |union| of their shingle sets. Null and empty texts, and texts without
    words, have an empty set and link with nothing: their component is their own id. Null ids take part in links and never name a
    component unless all its ids are null. Repeated rows stay and share a component. An empty table gives no rows; other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(rows, size), "signatures")
    nodes = stored(signed.where("name is not null").groupBy("name").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    light = nodes.select("name", "id")

    bands = nodes.select("name", F.explode("bands").alias("band"))
    # the pivot of a node is, over its bands, the node that shares its bands with most others: of a family, the text that its members were made from
    full = bands.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    bands = stored(bands.join(full, "band"), "bands")
    degree = bands.groupBy("name").agg(F.sum("k").alias("degree"))
    top = bands.join(degree, "name").groupBy("band").agg(F.max(F.struct("degree", "name")).alias("top"))
    chosen = bands.join(top, "band").groupBy("name").agg(F.max("top").alias("top")).select(F.col("name").alias("a"), F.col("top.name").alias("b"))
    chosen = stored(chosen.where("a <> b"), "chosen")
    ends = lambda d: d.select(F.col("a").alias("name")).union(d.select(F.col("b").alias("name"))).distinct()
    early = stored(ends(chosen), "early")
    texts = stored(named_texts(rows, early, size), "texts")
    classes = token_classes(signed.where("part is not null").select("part", "counts"))
    measured = stored(deltas(chosen, texts, size, percent), "deltas")
    hosts = measured.where("near")
    groups = nodes.select("name", "n").join(hosts.select(F.col("a").alias("name"), F.col("b").alias("pivot")), "name", "left")
    groups = stored(groups.select("name", "n", F.coalesce("pivot", "name").alias("grp")), "groups")

    tokens = prefixes(rows, size, percent, classes)
    by_token = Window.partitionBy("token")
    shared = tokens.withColumn("lo", F.min("name").over(by_token)).withColumn("hi", F.max("name").over(by_token)).where("lo <> hi").select("token", "name")
    shared = stored(shared.join(groups, "name").select("token", "name", "n", "grp").distinct(), "shared")
    matrix = shared.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    crossing = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    matrix = stored(matrix.join(crossing, "token", "left_semi"), "matrix")
    queries = shared.join(crossing, "token", "left_semi")
    opened = (
        queries.join(matrix.withColumnRenamed("grp", "other"), "token")
        .where((F.col("grp") < F.col("other")) & (F.col("most") * 100 >= F.col("n") * percent) & (F.col("least") * percent <= F.col("n") * 100))
        .groupBy(F.col("name").alias("a"), F.col("n").alias("na"), "other").agg(F.count(F.lit(1)).alias("common"))
        .where(F.col("common") >= F.greatest(F.lit(1), F.floor(F.ceil(F.col("na") * percent / 100) * EXTRA / 100)))
    )
    visits = stored(opened.select("a", F.col("other").alias("b")), "visits")
    late = stored(ends(visits).join(early, "name", "left_anti"), "late")
    texts = stored(named_texts(rows, late, size), "late-texts").union(texts)
    visited = stored(deltas(visits, texts, size, percent), "visited")
    pairs = stored(within_groups(hosts, visited, percent), "pairs")
    links = measured.union(visited).where("linked").select("a", "b").union(verified(pairs, texts, size, percent))
    least = components(light, links).select("name", "least")
    return signed.where("part is null").select("id", "n", "name").join(least, "name", "left").join(light.select("name", F.col("id").alias("own")), "name", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "own", "id").alias("component_id"))
