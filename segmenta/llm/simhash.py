"""SimHash near-duplicates found with vantage points.

A document has two fingerprints of 128 bits.  The coarse one sums the bits of the
hashes of all its words, each as often as it occurs; the fine one those of its
features: its distinct words and distinct word pairs.  Two documents are near
duplicates when their coarse fingerprints differ in COARSE bits at most, their fine
ones in RADIUS bits at most, and the smaller has at least RATIO of the features of
the larger.  Every such pair is found:

* Equal fingerprints are one node, whatever their number.
* The first vantage point is the empty document.  The distance to it is the
  number of features, and the ratio bound limits pairs to equal or adjacent
  levels of its logarithm.
* In a level, rings round one of the coarse fingerprints make cells of bounded size.
  Two cells whose rings are more than COARSE apart hold no pair (triangle bound);
  each other pair of cells is one task.
* A task builds a vantage-point tree of coarse fingerprints over one cell and sends
  the whole other cell down it, pruning branches by the same bound, with exact
  distances in the leaves.

Frequent words weigh most in coarse fingerprints, so these are far apart or close
together (a standard deviation of 16 bits, where the fine ones have 6 and no bound
of a useful radius prunes anything).  Still, texts of one language and length are
alike enough that a constant share of their pairs is compared; README has figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm import textkernel as tk
from segmenta.llm.common import DOCUMENT_COLUMNS, cut, dropped, map_batches, row_keys, written

RADIUS = 26
COARSE = 16
RATIO = 0.75
#: Fingerprints in a cell, which bounds a task's memory and time.
CELL = 40_000
LEAF = 256
PRINTS = ["f0", "f1", "c0", "c1"]
#: Steps of ``components`` at most; two to the power of half as many nodes can stand in a row.
MAX_STEPS = 100
_LANES = np.array([sum(((v >> (7 - bit)) & 1) << (8 * bit) for bit in range(8)) for v in range(256)], np.uint64)


def _features(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each document and their number."""
    pair, pair_counts = tk.shingles(h, counts, 2)
    docs = np.arange(len(counts), dtype=np.uint64) << np.uint64(44)
    single = pair_counts * (counts > 1)
    if not np.array_equal(single, pair_counts):
        pair = pair[np.repeat(counts > 1, pair_counts)]
    keys = np.concatenate([np.repeat(docs, counts) | (h >> np.uint64(20)), np.repeat(docs, single) | (tk.mix64(pair + np.uint64(5)) >> np.uint64(20))])
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return tk.mix64((keys & np.uint64((1 << 44) - 1)) + np.uint64(0x51ED270B)), np.diff(np.searchsorted(keys >> np.uint64(44), np.arange(len(counts) + 1, dtype=np.uint64)))


def _majority(f: np.ndarray, m: np.ndarray, out: np.ndarray) -> None:
    """Bits that more than half of each document's hashes have (``m`` of them), into the rows of ``out``."""
    some = np.flatnonzero(m)
    if not len(some):
        return
    # eight one-byte counters in a number, so runs of 255 hashes at most
    begin = np.cumsum(m)[some] - m[some]
    runs = -(-m[some] // 255)
    first = np.cumsum(runs) - runs
    starts = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    again = tk.mix64(f + np.uint64(0x9E3779B9))
    counts = np.empty((len(starts), 16), np.uint64)
    for half, x in enumerate((f, again)):
        octets = x.view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[:, half * 8 + j] = np.add.reduceat(_LANES[octets[:, j]], starts)
    ones = np.add.reduceat(counts.view(np.uint8).reshape(len(starts), 128), first, axis=0, dtype=np.int32)
    out[some] = np.packbits(ones * 2 > m[some][:, None], axis=1).view(np.uint64)


def fingerprint_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((n, 4) fine and coarse fingerprints, number of features) of texts; a text without words has 0 features."""
    body, offs = tk.raw(column)
    n = len(offs) - 1
    prints, sizes = np.zeros((n, 4), np.uint64), np.zeros(n, np.int64)
    for a, b in tk.pieces(offs):
        h, counts = tk.words(body[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        f, m = _features(h, counts)
        sizes[a:b] = m
        _majority(f, m, prints[a:b, :2])
        _majority(tk.mix64(h + np.uint64(0x3C6EF372)), counts, prints[a:b, 2:])
    return prints, sizes


def fingerprints(documents: DataFrame) -> DataFrame:
    """(r0, r1, doc_id, f0, f1, c0, c1, size) of each row; r0 and r1 are the same for equal rows."""
    r0, r1 = row_keys(documents)
    keyed = documents.select(r0.alias("r0"), r1.alias("r1"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes = fingerprint_column(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in prints.T], pa.array(sizes)], ["r0", "r1", "doc_id", *PRINTS, "size"])

    return map_batches(keyed, run, "r0 bigint, r1 bigint, doc_id bigint, f0 bigint, f1 bigint, c0 bigint, c1 bigint, size bigint")


# --- one task -------------------------------------------------------------------------------


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, 0] ^ b[0]).astype(np.int16) + np.bitwise_count(a[:, 1] ^ b[1])


def _leaf(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, radius: int, coarse: int, out: list) -> None:
    p = np.ascontiguousarray(b[ib].T)
    for at in range(0, len(ia), 128):
        q = ia[at : at + 128]
        near = np.bitwise_count(a[q, 0][:, None] ^ p[0][None, :])
        i, j = np.nonzero(near <= radius)
        d = near[i, j].astype(np.int16) + np.bitwise_count(a[q[i], 1] ^ p[1][j])
        ok = d <= radius
        i, j, d = i[ok], j[ok], d[ok]
        ok = np.bitwise_count(a[q[i], 2] ^ p[2][j]).astype(np.int16) + np.bitwise_count(a[q[i], 3] ^ p[3][j]) <= coarse
        if ok.any():
            out.append((q[i[ok]], ib[j[ok]], d[ok]))


def tree_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS, coarse: int = COARSE, leaf: int = LEAF, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, fine distance) of all a[i], b[j] that are within both radii.

    A vantage-point tree of the coarse fingerprints of ``b``; the queries ``a`` go down
    it together.  Where a point doesn't divide the others, the branch becomes a leaf.
    ``work`` gets the number of pairs that were compared.
    """
    out: list = []
    todo = [(np.arange(len(a)), np.arange(len(b)))]
    ca, cb = a[:, 2:], b[:, 2:]
    while todo:
        ia, ib = todo.pop()
        if not len(ia) or not len(ib):
            continue
        if len(ib) > leaf:
            # the point that is farthest from an arbitrary one stands at the rim
            v = cb[ib[int(np.argmax(_between(cb[ib], cb[ib[0]])))]]
            db, da = _between(cb[ib], v), _between(ca[ia], v)
            mu = int(np.median(db))
            low = db <= mu
            if not low.all():
                # the bound lies between the least distance outside and the greatest inside
                todo += [(ia[da <= mu + coarse], ib[low]), (ia[da >= int(db[~low].min()) - coarse], ib[~low])]
                continue
        if work is not None:
            work.append(len(ia) * len(ib))
        for at in range(0, len(ib), 4096):
            _leaf(a, ia, b, ib[at : at + 4096], radius, coarse, out)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _cell_pairs(rows: pd.DataFrame, radius: int, coarse: int, ratio: float) -> pd.DataFrame:
    own = rows[rows.side != 1]
    other = rows[rows.side != 0]
    prints = [np.ascontiguousarray(x[PRINTS].to_numpy(np.int64)).view(np.uint64) for x in (own, other)]
    i, j, d = tree_pairs(prints[0], prints[1], radius, coarse)
    na, nb, sa, sb = own.node.to_numpy()[i], other.node.to_numpy()[j], own["size"].to_numpy()[i], other["size"].to_numpy()[j]
    ok = np.minimum(sa, sb) >= ratio * np.maximum(sa, sb)
    if len(rows) and rows.side.iloc[0] == 2:
        ok &= na < nb
    return pd.DataFrame({"a": np.minimum(na, nb)[ok], "b": np.maximum(na, nb)[ok], "distance": d[ok].astype(np.int32)})


def _forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """Star edges with the same connected components."""
    nodes, ends = np.unique(np.concatenate([pairs.a, pairs.b]), return_inverse=True)
    u, v = ends[: len(pairs)], ends[len(pairs) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while not np.array_equal(new, again := new[new]):
            new = again
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[root[moved]], "b": nodes[moved]})


# --- distributed search ---------------------------------------------------------------------


def near_pairs(nodes: DataFrame, radius: int = RADIUS, ratio: float = RATIO, cell: int = CELL, forest: bool = False, coarse: int = COARSE) -> DataFrame:
    """All pairs (a < b, distance) of near-duplicate nodes; with ``forest``, edges (a, b) with the same components.

    ``nodes`` has node, f0, f1, c0, c1 and size > 0, one row a node.  The driver gets one
    fingerprint and a histogram of levels and ring distances (129 a level at most), and
    makes from it groups of neighbouring rings and the pairs of groups that can hold
    near duplicates; their number doesn't depend on that of the nodes.  Groups of more
    than ``cell`` nodes have parts, and executors list the tasks of each pair of parts.
    """
    spark = nodes.sparkSession
    base = float(np.log(1 / ratio))
    vantage = nodes.agg(F.min_by(F.struct("c0", "c1"), "node")).first()[0] or (0, 0)
    ring = F.bit_count(F.col("c0").bitwiseXOR(F.lit(vantage[0]))) + F.bit_count(F.col("c1").bitwiseXOR(F.lit(vantage[1])))
    placed = nodes.select("node", *PRINTS, "size", F.floor(F.log("size") / F.lit(base)).cast("int").alias("level"), ring.cast("int").alias("ring"))
    home: list[tuple[int, int, int]] = []  # level, ring, group
    groups: list[list[int]] = []  # level, least and greatest ring, nodes
    for level, r, n in sorted((r[0], r[1], r[2]) for r in placed.groupBy("level", "ring").count().collect()):
        if groups and groups[-1][0] == level and groups[-1][3] + n <= cell:
            groups[-1][2:] = [r, groups[-1][3] + n]
        else:
            groups.append([level, r, r, n])
        home.append((level, r, len(groups) - 1))
    parts = [-(-n // cell) for *_, n in groups]
    of_level: dict[int, list[int]] = {}
    for g, (level, *_) in enumerate(groups):
        of_level.setdefault(level, []).append(g)
    visits: list[tuple[int, int, int, int, int]] = []  # group, pair, side (2: the group against itself), own parts, parts of the other
    for g, (level, low, high, _) in enumerate(groups):
        for h in [*of_level[level], *of_level.get(level + 1, [])]:
            if groups[h][0] == level and h < g or max(low, groups[h][1]) - min(high, groups[h][2]) > coarse:
                continue
            pair = len(visits)
            visits += [(g, pair, 2, parts[g], parts[g])] if g == h else [(g, pair, 0, parts[g], parts[h]), (h, pair, 1, parts[h], parts[g])]
    homes = spark.createDataFrame(home, "level int, ring int, group int")
    visit = spark.createDataFrame(visits, "group int, pair int, side int, parts int, others int")
    part, other = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("others") - 1)

    def task(q: Column) -> Column:
        """(p, q, side) of the node's part against part q of the other group."""
        inside = F.struct(F.least(part, q).alias("p"), F.greatest(part, q).alias("q"), F.when(part == q, 2).when(part < q, 0).otherwise(1).alias("s"))
        across = F.struct(F.when(F.col("side") == 0, part).otherwise(q).alias("p"), F.when(F.col("side") == 0, q).otherwise(part).alias("q"), F.col("side").alias("s"))
        return F.when(F.col("side") == 2, inside).otherwise(across)

    sent = placed.join(F.broadcast(homes), ["level", "ring"]).join(F.broadcast(visit), "group").withColumn("t", F.explode(F.transform(other, task)))

    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = _cell_pairs(rows, radius, coarse, ratio)
        return _forest(found) if forest else found

    return sent.select("pair", "t.p", "t.q", F.col("t.s").alias("side"), "node", *PRINTS, "size").groupBy("pair", "p", "q").applyInPandas(run, "a bigint, b bigint" + ("" if forest else ", distance int"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the connected component of each node of (a, b).

    Large-star and small-star steps in turn, each written to the checkpoint folder,
    until the edges stay as they are; then they are stars.  The number of steps grows
    with the logarithm of the longest path; edges that still change after MAX_STEPS
    are an error.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    for _ in range(MAX_STEPS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(up, "b")
        last, edges = edges, written(joined.select(F.col("m").alias("a"), "b").unionByName(joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
        dropped(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _groups(documents: DataFrame, radius: int, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(prints of all rows, (node, group_id, group_size, first) of each node); first is the row that its group keeps.

    Rows of a fingerprint are counted before anything is grouped, so a group of copies is one row here.
    """
    prints = cut(fingerprints(documents).withColumn("node", F.xxhash64(*PRINTS, "size")).withColumn("n", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r0", "r1", "n")).alias("first")
    nodes = cut(prints.where("size > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in (*PRINTS, "size")], first, F.count("*").alias("rows")))
    roots = components(near_pairs(nodes, radius, ratio, forest=True))
    placed = nodes.select("node", "first", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = placed.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("group_size"))
    return prints, placed.select("node", "root").join(groups, "root").select("node", F.col("first.doc_id").alias("group_id"), "group_size", "first")


def near_groups(documents: DataFrame, radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """(doc_id, group_id, group_size, kept) of every row that has a near duplicate.

    A group is a connected component of near-duplicate pairs; ``group_id`` is its
    least doc_id.  One row of it is kept: the least doc_id, nulls last; of equal rows,
    any.  Equal rows are copies of each other.  Null texts and texts without words are
    in no group.  An empty table gives no rows.  Other columns are ignored.
    """
    prints, groups = _groups(documents, radius, ratio)
    found = groups.where("group_size > 1").select("node", "group_id", "group_size", F.col("first.n").alias("_n"))
    return prints.select("node", "doc_id", "n").join(found, "node").select("doc_id", "group_id", "group_size", (F.col("n") == F.col("_n")).alias("kept"))


def dedup(documents: DataFrame, radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """The documents without near duplicates: of each group the row that ``near_groups`` keeps.

    Null texts and texts without words stay, once for equal rows.  A row is known by 128
    bits of hashes of its values.  Columns are those of documents, unchanged; others are
    left out, whatever their names.  An empty table stays empty.
    """
    prints, groups = _groups(documents, radius, ratio)
    pick = groups.select("first.r0", "first.r1").unionByName(prints.where("size = 0").select("r0", "r1")).distinct()
    whole = documents.select(*DOCUMENT_COLUMNS)
    r0, r1 = row_keys(whole)
    return whole.withColumn("r0", r0).withColumn("r1", r1).join(pick, ["r0", "r1"], "left_semi").dropDuplicates(["r0", "r1"]).select(*DOCUMENT_COLUMNS)
