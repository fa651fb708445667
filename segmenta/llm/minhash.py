"""Document fingerprints with MinHash.

A document's shingles are the hashes of its runs of SHINGLE words, as a set.  Each
of PERMUTATIONS universal hashes h -> ((a h + b) mod 2^64) div 2^32, a odd, keeps its
least value; BANDS bands of the signature are joined in Spark, and the
Jaccard similarity of the whole shingle sets decides.  Documents with equal sets
are joined by a hash of the set, and one stands for all of them.  Every pair of
distinct sets that agrees in a band is verified and given, as a list of partners of
each set; copies name their set, as the pairs of a group of copies grow with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm import textkernel as tk
from segmenta.llm.common import cut, map_batches
from segmenta.llm.simhash import components

SHINGLE = 5
BANDS = 16
ROWS = 5
PERMUTATIONS = BANDS * ROWS
THRESHOLD = 0.7
#: (threshold, bands, rows of a band) that find edited copies: a changed word takes SHINGLE shingles away on both
#: sides, so one word in 17 changed leaves about 0.59, one in 24 about 0.68; 26 bands of 3 rows find 0.5 with probability 0.969.
EDITED = (0.5, 26, 3)
#: Shingles that one task holds, about, with OWN for each set; a single set can have more.
CELL = 8_000_000
OWN = 100
#: Shingles that are looked up at once, about, beyond those of one set.
GATHER = 1 << 22
_RNG = np.random.Generator(np.random.PCG64(1061))
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit shingles of each text, distinct and in order; their number) of texts laid end to end."""
    h, counts = tk.shingles(*tk.words(body, offs), SHINGLE)
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = (doc << np.uint64(32)) | (h >> np.uint64(32))
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.diff(np.searchsorted(keys >> np.uint64(32), np.arange(len(counts) + 1, dtype=np.uint64)))


def signatures(flat: np.ndarray, counts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """(texts, permutations) least permuted values, of PERMUTATIONS at most; texts without shingles have the greatest."""
    out = np.full((len(counts), permutations), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    begin = np.cumsum(counts)[some] - counts[some]
    x = flat.astype(np.uint64)
    for i in range(permutations):
        y = x * _A[i]
        y += _B[i]
        y >>= np.uint64(32)
        out[some, i] = np.minimum.reduceat(y, begin)
    return out


def set_hash(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, by summing mixed members."""
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate(tk.mix64(flat.astype(np.uint64) + np.uint64(0x632BE59B)))]) if len(flat) else np.zeros(1, np.uint64)
    end = np.cumsum(counts)
    return tk.mix64(sums[end] - sums[end - counts] + counts.astype(np.uint64))


def _shrunk(values: np.ndarray) -> bytes:
    """Numbers in ascending order as differences, byte plane by byte plane, which the shuffle's compression shortens."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _grown(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _fingerprints(documents: DataFrame, with_bands: bool, with_sets: bool, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """(doc_id, set, size, bands, shingles) of each row; with ``with_sets``, of each set once in a task."""
    schema = "doc_id bigint, set bigint, size int" + (", bands array<bigint>" if with_bands else "") + (", shingles binary" if with_sets else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            body, offs = tk.raw(batch.column(1))
            n = len(offs) - 1
            key, size, bands, sets = np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros((n, n_bands), np.uint64), []
            for a, b in tk.pieces(offs):
                flat, counts = shingle_sets(body[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                key[a:b], size[a:b] = set_hash(flat, counts), counts
                if with_bands:
                    s = signatures(flat, counts, n_bands * n_rows).astype(np.uint64).reshape(b - a, n_bands, n_rows)
                    h = np.broadcast_to(np.arange(n_bands, dtype=np.uint64), (b - a, n_bands)).copy()
                    for r in range(n_rows):
                        h = tk.mix64(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r] + np.uint64(r))
                    bands[a:b] = h
                if with_sets:
                    end = np.cumsum(counts)
                    sets += [_shrunk(flat[e - k : e]) for e, k in zip(end, counts, strict=True)]
            cols = [batch.column(0), pa.array(key.view(np.int64)), pa.array(size)]
            if with_bands:
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_bands + 1, n_bands, dtype=np.int32)), pa.array(bands.view(np.int64).ravel())))
            if with_sets:
                cols.append(pa.array(sets, pa.binary()))
            made = pa.RecordBatch.from_arrays(cols, names)
            if with_sets:
                first = []
                for x, k in zip(key.tolist(), size.tolist(), strict=True):
                    first.append(k > 0 and x not in seen)
                    seen.add(x)
                made = made.filter(pa.array(first, pa.bool_()))
            yield made

    return map_batches(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, schema)


def _verified(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(set, set_id, jaccard): for each set the similar sets that share a band with it, and their similarities.

    Every pair that shares a band is compared once, whatever else is similar; in the
    task of two parts, only pairs across them; in the task of one band, only pairs
    that share no earlier band.
    """
    n, across = len(rows), len(rows) > 0 and rows["p"].iloc[0] != rows["q"].iloc[0]
    only = int(rows["band"].iloc[0]) if len(rows) else -1
    sets, part = rows["set"].to_numpy(), rows["part"].to_numpy()
    shingles = [_grown(x) for x in rows["shingles"]]
    bands = np.stack(rows["bands"].to_numpy())
    sizes = np.array([len(x) for x in shingles])
    begin = np.cumsum(sizes) - sizes
    words, code = np.unique(np.concatenate(shingles), return_inverse=True)
    shared: list[list[np.ndarray]] = [[] for _ in range(n)]
    for k in range(bands.shape[1]) if only < 0 else [only]:
        order = np.argsort(bands[:, k], kind="stable")
        value = bands[order, k]
        edges = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo > 1:
                members = order[lo:hi]  # in order, as the sort is stable
                for at, i in enumerate(members[:-1].tolist()):
                    shared[i].append(members[at + 1 :])
    mark = np.zeros(len(words), bool)
    found = []
    for i in range(n):
        if not shared[i]:
            continue
        other = np.unique(np.concatenate(shared[i]))
        shared[i] = []
        # the ratio of sizes bounds the similarity
        other = other[np.minimum(sizes[other], sizes[i]) >= threshold * np.maximum(sizes[other], sizes[i])]
        if across:
            other = other[part[other] != part[i]]
        if only > 0:
            other = other[~(bands[other, :only] == bands[i, :only]).any(axis=1)]
        own = code[begin[i] : begin[i] + sizes[i]]
        mark[own] = True
        for j in np.split(other, np.flatnonzero(np.diff(np.cumsum(sizes[other]) // GATHER)) + 1):
            if len(j):
                first = np.cumsum(sizes[j]) - sizes[j]
                both = np.add.reduceat(mark[code[np.repeat(begin[j] - first, sizes[j]) + np.arange(sizes[j].sum())]], first, dtype=np.int64)
                s = both / (sizes[i] + sizes[j] - both)
                ok = s >= threshold
                if ok.any():
                    found.append((np.full(int(ok.sum()), i), j[ok], s[ok]))
        mark[own] = False
    if not found:
        none = pd.Series([], dtype=object)
        return pd.DataFrame({"set": np.zeros(0, np.int64), "set_id": none, "jaccard": none})
    x, y, s = (np.concatenate(c) for c in zip(*found, strict=True))
    x, y, s = np.concatenate([x, y]), np.concatenate([y, x]), np.round(np.concatenate([s, s]), 6)
    order = np.argsort(x, kind="stable")
    mine, at = np.unique(x[order], return_index=True)
    return pd.DataFrame({"set": sets[mine], "set_id": np.split(sets[y[order]], at[1:]), "jaccard": np.split(s[order], at[1:])})


def similar_groups(documents: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, group_id, group_size, jaccard, set_id, partners) of every row that is similar to another.

    Two rows are similar when the Jaccard similarity of their shingle sets is
    ``threshold`` at least and a band of their signatures agrees; a group is a
    connected component of similar rows, named by its least doc_id (nulls last).
    ``jaccard`` is the row's greatest similarity to another row, 1 for rows with equal
    sets.  ``set_id`` is a hash of the set, alike for equal sets.  ``partners`` has the
    (set_id, jaccard) of every other similar set, in order; of rows with equal sets those
    with the least doc_id (nulls last) have it and the others have null.  So all pairs of similar rows
    follow from the rows: no partner is capped or left out, and a pair is compared
    whatever other pairs connect.  Null texts and texts without words are in no group.
    Repeated rows are similar to each other.  An empty table gives no rows.  Other
    columns are ignored.

    One plan serves tables of any size.  Bands link each set with the least set of the
    band.  A component of linked sets that has CELL shingles at most is compared in
    one task, which gets each set once.  A larger one is compared band by band, so a
    set is sent once for each band that it shares; a band of more than CELL shingles
    is divided into parts, with a task for each pair of parts.  Shingles are made
    anew from the texts and shuffled once; texts are never shuffled.
    """
    if bands < 1 or rows < 1 or bands * rows > PERMUTATIONS:
        raise ValueError("bands times rows must be between 1 and PERMUTATIONS")
    prints = cut(_fingerprints(documents, True, False, bands, rows).where("size > 0"))
    reps = cut(prints.groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
    each = reps.select("set", F.explode("bands").alias("value"))  # a value tells its band
    hot = each.groupBy("value").agg(F.min("set").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = cut(each.join(hot, "value"))
    near = components(shared.select(F.col("least").alias("a"), F.col("set").alias("b")))  # candidates: every set with a partner in some band
    load = F.col("size").cast("bigint") + OWN
    rooted = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "set").join(reps.select("set", "size", "bands"), "set")
    whole = rooted.groupBy("root").agg(F.sum(load).alias("all"))
    wanted = cut(rooted.join(whole, "root").select("set", "bands", load.alias("load"), "root", (F.col("all") > CELL).alias("large")))
    by_band = wanted.where("large").select("set", "bands", "load").join(shared.select("set", "value"), "set")
    parts = by_band.groupBy("value").agg(F.ceil(F.sum("load") / F.lit(CELL)).cast("int").alias("parts"))
    by_band = by_band.join(parts, "value").select("set", "bands", (F.array_position("bands", F.col("value")) - 1).cast("int").alias("band"), F.col("value").alias("task"), "parts")
    visits = wanted.where("NOT large").select("set", "bands", F.lit(-1).alias("band"), F.col("root").alias("task"), F.lit(1).alias("parts")).unionByName(by_band)
    part = F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")
    # a set of part p is in the tasks (p, q) of all q, with the lesser part first
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(part, q).alias("p"), F.greatest(part, q).alias("q")))
    visits = visits.select("set", "bands", "band", "task", part.alias("part"), F.explode(pairs).alias("t")).select("set", "bands", "band", "task", "part", "t.p", "t.q")
    found = _fingerprints(documents, False, True).select("set", "shingles")
    held = found.join(wanted.select("set"), "set", "left_semi").dropDuplicates(["set"])
    sent = held.join(visits, "set")

    def run(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _verified(frame, threshold)

    lists = cut(sent.groupBy("band", "task", "p", "q").applyInPandas(run, "set bigint, set_id array<bigint>, jaccard array<double>"))
    partners = lists.groupBy("set").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("set_id", "jaccard")))).alias("partners"))
    roots = components(lists.select(F.col("set").alias("a"), F.explode("set_id").alias("b")).where("a < b"))
    # groups are made of sets, copies having been counted, and rows only look up their set
    placed = reps.select("set", "doc_id", "copies").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    sizes = placed.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.sum("copies").alias("group_size")).where("group_size > 1")
    best = F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.array_max("partners.jaccard"))
    none = F.array().cast("array<struct<set_id:bigint,jaccard:double>>")
    of_set = placed.join(sizes, "root").join(partners, "set", "left").select("set", F.col("doc_id").alias("_first"), "group_id", "group_size", best.alias("jaccard"), F.coalesce("partners", none).alias("partners"))
    mine = F.when(F.col("doc_id").eqNullSafe(F.col("_first")), F.col("partners"))
    return prints.select("set", "doc_id").join(of_set, "set").select("doc_id", "group_id", "group_size", "jaccard", F.col("set").alias("set_id"), mine.alias("partners"))
