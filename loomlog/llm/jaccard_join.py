"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the classes of linked documents.

The search needs inverted lists of documents that could be similar, and only of those, in one place:

1. Documents with equal sets form a class; a class is searched for once.
2. A fixed-size sketch of shingle frequencies orders all shingles by rarity. Similar sets share one of their rarest
   shingles (prefix filter), and no set is over a fifth larger than a similar one (length filter). Classes that share a
   prefix shingle at compatible sizes are joined into cells; of few classes with a shingle, only pairs whose signatures
   (parities of hashed shingles) don't differ in more places than similar sets can. Without this, chance meetings of
   prefix shingles, ever more as data grow, would join most classes into one cell.
3. In each cell, in order of size, each set searches the inverted lists of the sets before it: short lists are merged
   with a heap that skips, long ones are probed by binary search.
4. The links' connected components are the result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen, make_room, parallelism
from .components import connected_components
from .shingles import as_set_key, concatenated, forget, shingle_set

#: Similarity, as a fraction: 100 * intersection >= 80 * union.
SIMILAR = (80, 100)
#: Counters of the frequency sketch and its slices; its size is the same for any input.
SKETCH_BITS, SLICES = 23, 64
#: Classes that share a shingle at compatible sizes, up to which all their pairs are compared by signature; more are joined in a chain.
PAIRED = 16
#: The least number of bits of a signature.
LEAST_BITS = 64
#: Prefix entries that a task holds before it passes them on.
HELD = 2_000_000
#: Sets that meet in one task for one cell; larger cells are searched block against block.
BLOCK_SETS = 4_000
#: Documents to search whose keys may be broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: DivideSkip's constant for how many long lists to set aside.
MU = 0.0085


def required(size: int, other: int, similar: tuple[int, int] = SIMILAR) -> int:
    """The least overlap of similar sets of these sizes."""
    part, whole = similar
    return -(-part * (size + other) // (whole + part))


def smallest_similar(size: int, similar: tuple[int, int] = SIMILAR) -> int:
    """The least size of a set similar to one of this size, and the least overlap with any similar set."""
    return -(-similar[0] * size // similar[1])


def merge_skip(lists: list[list[int]], starts: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(value, lists that have it) of values on at least ``least`` of the ascending lists, from ``starts`` on.

    A heap holds each list's next value. When the smallest value is on too few lists, ``least - 1`` lists are popped in all
    and jump, by binary search, to the smallest value that is left: nothing between can be on enough lists.
    """
    heap = [(values[at], i, at) for i, (values, at) in enumerate(zip(lists, starts, strict=True)) if at < len(values)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield top, len(popped)
            for _, i, at in popped:
                if at + 1 < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at + 1], i, at + 1))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            return
        target = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(lists[i], target, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))


class Inverted:
    """Inverted lists of sets that arrive in order of size."""

    def __init__(self, similar: tuple[int, int] = SIMILAR):
        self.similar, self.sizes = similar, []
        self.lists: dict[int, list[int]] = defaultdict(list)

    def search(self, shingles: list[int]) -> list[int]:
        """Positions of the sets so far that are similar to this one, which is at least as large as each of them."""
        size = len(shingles)
        least = smallest_similar(size, self.similar)
        first = bisect_left(self.sizes, least)
        if first == len(self.sizes) or not size:
            return []
        get = self.lists.get
        lists = [x for s in shingles if (x := get(s)) is not None and x[-1] >= first]
        if len(lists) < least:
            return []
        lists.sort(key=len)
        aside = min(least - 1, int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        found = []
        for candidate, count in merge_skip(short, [bisect_left(x, first) for x in short], least - aside):
            need = required(size, self.sizes[candidate], self.similar) - count
            left = len(long)
            for values in long:
                if need <= 0 or need > left:
                    break
                at = bisect_left(values, candidate)
                need -= at < len(values) and values[at] == candidate
                left -= 1
            if need <= 0:
                found.append(candidate)
        return found

    def add(self, shingles: list[int]) -> None:
        here = len(self.sizes)
        self.sizes.append(len(shingles))
        for s in shingles:
            self.lists[s].append(here)


def _pressed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _unpressed(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the number of shingles in each of 2 ** k places, about as many places as shingles."""
    bits = max(LEAST_BITS, 1 << (len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def may_be_similar(one: bytes, two: bytes, size: int, other: int, similar: tuple[int, int] = SIMILAR) -> bool:
    """Whether sets of these signatures and sizes can be similar: places that differ are at most the shingles that differ."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    while len(a) > len(b):  # a longer signature folds to half its length
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= size + other - 2 * required(size, other, similar)


def _described(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Per document: key, set key, size, signature; besides, rows with slices of the partition's shingle counts (sketch)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {docs.schema[key].dataType.simpleString()}, cls long, n long, sig binary, slice int, counts binary"
    names = ["key", "cls", "n", "sig", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        counts, held, pending = None, 0, []

        def add() -> None:
            nonlocal counts, held
            counts = np.zeros(1 << SKETCH_BITS, np.uint32) if counts is None else counts
            for found in pending:
                np.add.at(counts, (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            pending.clear()
            held = 0

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            classes, sizes, signatures = [], [], []
            for body in batch.column(1):
                found = shingle_set(body.as_py(), width)
                classes.append(as_set_key(found))
                sizes.append(len(found))
                signatures.append(signature(found) if len(found) else None)
                pending.append(found)
                held += len(found)
                if held > HELD:
                    add()
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        forget()
        if pending:
            add()
        if counts is not None:
            blobs = [_pressed(x) for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, key_type), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return rows.mapInArrow(run, schema)


def _sketch(described: DataFrame) -> np.ndarray:
    """Logarithms of the summed counts, one byte a counter: 8 MiB, whatever the input."""

    def total(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
        for blob in part["counts"]:
            counts += _unpressed(blob, "<u4")
        code = np.minimum(8 * np.log2(1.0 + counts), 255).astype(np.uint8)
        return pd.DataFrame({"slice": [int(part["slice"].iloc[0])], "code": [code.tobytes()]})

    def halves(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
        for blob in part["counts"]:
            counts += _unpressed(blob, "<u4")
        return pd.DataFrame({"slice": [int(part["slice"].iloc[0])], "counts": [_pressed(np.minimum(counts, 2**32 - 1).astype("<u4"))]})

    blobs = described.where("slice is not null").select("slice", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))
    some = blobs.groupBy("slice", "salt").applyInPandas(halves, "slice int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    size = len(out) // SLICES
    for row in some.groupBy("slice").applyInPandas(total, "slice int, code binary").collect():
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(bytes(row["code"]), np.uint8)
    return out


def prefix(shingles: np.ndarray, codes: np.ndarray, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The rarest shingles of a set: of two similar sets, one is in both prefixes. Ties in rarity go by hash."""
    size = len(shingles)
    order = np.argsort(codes[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return shingles[order[: size - smallest_similar(size, similar) + 1]]


class Entries:
    """Prefix entries in order of their hashes and sizes: hash, class, least and largest size, number of entries it stands for.

    Entries with one hash whose size ranges touch are a run.
    """

    def __init__(self, hashes: np.ndarray, classes: np.ndarray, low: np.ndarray, high: np.ndarray, stand: np.ndarray, similar: tuple[int, int]):
        order = np.lexsort((-stand, classes, high, low, hashes))
        every = [x[order] for x in (hashes, classes, low, high, stand)]
        first = np.ones(len(order), bool)  # of the copies of a document, with the largest number
        first[1:] = np.any([x[1:] != x[:-1] for x in every[:4]], axis=0)
        self.hashes, self.classes, self.low, self.high, self.stand = (x[first] for x in every)
        self.similar = similar
        new = np.ones(len(self.hashes), bool)
        new[1:] = self.hashes[1:] != self.hashes[:-1]
        group = np.cumsum(new) - 1
        reach = np.maximum.accumulate(self.high + group * (1 << 40)) - group * (1 << 40)  # the largest size so far with this hash
        new[1:] |= reach[:-1] * similar[1] < self.low[1:] * similar[0]
        self.run = np.cumsum(new) - 1
        self.starts = np.flatnonzero(new)
        self.held = np.add.reduceat(self.stand, self.starts) if len(self.starts) else self.stand
        self.many = self.held > PAIRED

    def chains(self) -> np.ndarray:
        """Edges between neighbours in runs of many entries."""
        at = np.flatnonzero((self.run[1:] == self.run[:-1]) & self.many[self.run[1:]])
        return _edges([(self.classes[at], self.classes[at + 1])])

    def pairs(self) -> np.ndarray:
        """All pairs of compatible sizes in runs of few entries."""
        some = np.flatnonzero(~self.many[self.run])
        run, size, classes = self.run[some], self.low[some], self.classes[some]
        found = []
        for far in range(1, min(PAIRED, len(some))):
            at = np.flatnonzero((run[far:] == run[:-far]) & (size[:-far] * self.similar[1] >= size[far:] * self.similar[0]))
            if not len(at):
                break
            found.append((classes[at], classes[at + far]))
        return _edges(found)

    def short(self) -> tuple[np.ndarray, ...]:
        """Hashes, classes, least and largest sizes, numbers: one entry for each run of many, the others as they are."""
        kept = ~self.many[self.run]
        kept[self.starts] = True
        run = self.run[kept]
        many = self.many[run]
        largest = np.maximum.reduceat(self.high, self.starts) if len(self.starts) else self.high
        return self.hashes[kept], self.classes[kept], self.low[kept], np.where(many, largest[run], self.high[kept]), np.where(many, self.held[run], self.stand[kept])


def _edges(ends: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distinct edges, the larger end first, without loops."""
    u, v = (concatenated((x[i] for x in ends), np.int64) for i in (0, 1))
    return np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1)[u != v], axis=0)


def _cell_edges(docs: DataFrame, text: str, codes: np.ndarray, width: int, similar: tuple[int, int], buckets: int) -> DataFrame:
    """Edges (u, v, sure) between classes that may be similar: those not sure need be kept only if signatures allow it; the
    others connect the classes of runs of many entries.

    A task joins neighbours in runs of many among its own entries and passes on one entry for each such run, so that a shingle
    of very many documents arrives as a few entries a task.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(codes)
    arrays = ("hashes", "blob", "low", "more", "stand")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes, sizes, held = [], [], [], 0

        def passed() -> pa.RecordBatch:
            h, c, n = concatenated(hashes, np.uint64), concatenated(classes, np.int64), concatenated(sizes, np.int64)
            for x in (hashes, classes, sizes):
                x.clear()
            own = Entries(h, c, n, n, np.ones(len(h), np.int64), similar)
            rows = {"bucket": [-1], "blob": [_pressed(own.chains())], **{k: [b""] for k in arrays if k != "blob"}}
            h, c, low, high, stand = own.short()
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((c, bucket))
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in range(buckets):
                some = by[cuts[b] : cuts[b + 1]]
                if len(some):
                    rows["bucket"].append(b)
                    for name, array in zip(arrays, (h[some], c[some], low[some].astype("<u4"), (high - low)[some].astype("<u4"), stand[some].astype("<u4")), strict=True):
                        rows[name].append(_pressed(array))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int32()), **{k: pa.array(rows[k], pa.binary()) for k in arrays}})

        for batch in batches:
            for body in batch.column(0):
                found = shingle_set(body.as_py(), width)
                if len(found):
                    rare = prefix(found, shipped.value, similar)
                    hashes.append(rare)
                    classes.append(np.full(len(rare), as_set_key(found), np.int64))
                    sizes.append(np.full(len(rare), len(found), np.int64))
                    held += len(rare)
                    if held >= HELD:
                        yield passed()
                        held = 0
        forget()
        if held:
            yield passed()

    def across(part: pd.DataFrame) -> pd.DataFrame:
        if int(part["bucket"].iloc[0]) < 0:
            sure, pairs = concatenated((_unpressed(x, "<i8").reshape(-1, 2) for x in part["blob"]), np.int64).reshape(-1, 2), np.zeros((0, 2), np.int64)
        else:
            low, more, stand = (concatenated((_unpressed(x, "<u4") for x in part[k]), np.uint32).astype(np.int64) for k in ("low", "more", "stand"))
            every = Entries(concatenated((_unpressed(x, "<u8") for x in part["hashes"]), np.uint64), concatenated((_unpressed(x, "<i8") for x in part["blob"]), np.int64), low, low + more, stand, similar)
            sure, pairs = every.chains(), every.pairs()
        both = np.concatenate([sure, pairs])
        return pd.DataFrame({"u": both[:, 0], "v": both[:, 1], "sure": np.arange(len(both)) < len(sure)})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(local, "bucket int, " + ", ".join(f"{k} binary" for k in arrays))
    # a task's own edges (bucket -1) are dealt out; a bucket is one group
    rows = rows.withColumn("deal", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("blob"), F.lit(buckets))).otherwise(F.col("bucket").cast("long")))
    found = rows.groupBy("deal", "bucket").applyInPandas(across, "u long, v long, sure boolean")
    return found.groupBy("u", "v").agg(F.max("sure").alias("sure"))


def _possible(edges: DataFrame, documents: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Edges (u, v) that are sure, or whose ends' signatures allow them to be similar."""
    asked = edges.where("not sure")
    ends = asked.select(F.col("u").alias("cls")).union(asked.select("v")).distinct()
    signed = frozen(documents.where("n > 0").select("cls", "n", "sig").dropDuplicates(["cls"]).join(ends, "cls", "left_semi"))
    for end in ("u", "v"):
        asked = asked.join(signed.select(F.col("cls").alias(end), F.col("n").alias(f"n_{end}"), F.col("sig").alias(f"sig_{end}")), end)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(x.to_pylist() for x in batch.columns[2:]), strict=True)
            yield batch.select(["u", "v"]).filter(pa.array([may_be_similar(a, b, m, n, similar) for a, b, m, n in rows], pa.bool_()))

    near = asked.select("u", "v", "sig_u", "sig_v", "n_u", "n_v").mapInArrow(compared, "u long, v long")
    return edges.where("sure").select("u", "v").union(near)


def _searched(sets: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """Links and link counts: rows (u, v, null, null) join two classes; rows (u, null, links) count u's similar documents.

    Only enough links for the components are returned, besides all counts.
    """

    def search(part: pd.DataFrame) -> pd.DataFrame:
        out_u, out_v, out_n = [], [], []
        for (_, left, right), cell in part.groupby(["cell", "i", "j"], sort=False):
            cell = cell.drop_duplicates("cls").sort_values(["n", "cls"])
            index, members = Inverted(similar), []
            counts: dict[int, int] = defaultdict(int)
            root: dict[int, int] = {}

            def top(x: int, root: dict[int, int] = root) -> int:
                while (y := root.setdefault(x, x)) != x:
                    root[x] = x = root[y]
                return x

            for cls, block, copies, blob in zip(cell["cls"], cell["block"], cell["copies"], cell["shingles"], strict=True):
                shingles = np.frombuffer(blob, "<u8").tolist()
                for at in index.search(shingles):
                    other, other_block, other_copies = members[at]
                    if left != right and block == other_block:
                        continue  # found where the block meets itself
                    counts[cls] += other_copies
                    counts[other] += copies
                    a, b = top(cls), top(other)
                    if a != b:
                        root[a] = b
                        out_u.append(cls)
                        out_v.append(other)
                        out_n.append(None)
                index.add(shingles)
                members.append((cls, block, copies))
            for cls, n in counts.items():
                out_u.append(cls)
                out_v.append(None)
                out_n.append(n)
        return pd.DataFrame({"u": pd.array(out_u, "Int64"), "v": pd.array(out_v, "Int64"), "links": pd.array(out_n, "Int64")})

    return sets.groupBy("deal").applyInPandas(search, "u long, v long, links long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key reachable by links, its own included) and
    n_links (other documents whose sets have 100 * intersection >= 80 * union with its own).

    Sets are of runs of ``width`` words of the whole text; with fewer words, the whole sequence is one shingle. Null and
    empty texts have no set and are linked with nothing. Repeated rows and keys count as documents of their own; a null
    key is never the smallest unless all keys of a component are null. An empty table gives no rows; other columns are
    ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    described = frozen(_described(docs, key, text, width))
    documents = described.where("slice is null")
    classes = documents.where("n > 0").groupBy("cls").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    buckets = 4 * parallelism(docs)
    edges = frozen(_cell_edges(docs, text, _sketch(described), width, similar, buckets))
    cells = connected_components(_possible(edges, documents, similar))
    cells = frozen(cells.select(F.col("node").alias("cls"), F.col("root").alias("cell")).join(classes, "cls"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("blocks"))
    wanted = cells.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    few = cells.count() <= BROADCAST_KEYS
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    asked = wanted.select("key", "cls", "cell", "copies", "n", "blocks", "block")
    fetched = texts.join(F.broadcast(asked) if few else asked, texts["key"].eqNullSafe(asked["key"])).select(asked["cls"], "cell", "copies", "n", "blocks", "block", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), width) for x in batch.column(6)]
            keep = [i for i, (s, c) in enumerate(zip(found, batch.column(0).to_pylist(), strict=True)) if as_set_key(s) == c]  # others share the key only
            picked = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns[:6], pa.array([found[i].tobytes() for i in keep], pa.binary())], names=["cls", "cell", "copies", "n", "blocks", "block", "shingles"])
        forget()

    sets = fetched.mapInArrow(hashed, "cls long, cell long, copies long, n long, blocks long, block int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other")
    met = sets.select("*", other).select("cls", "cell", "copies", "n", "block", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # small cells share a group; blocks of a large cell meet in groups of their own
    met = met.withColumn("deal", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(buckets)))
    found = frozen(_searched(met, width, similar))
    roots = connected_components(found.where("v is not null")).select(F.col("node").alias("cls"), "root")
    counts = found.where("links is not null").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
    per_class = classes.join(roots, "cls", "left").join(counts, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = per_class.groupBy("root").agg(F.min("key").alias("component"))
    per_class = per_class.join(smallest, "root").select("cls", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = documents.where("n > 0").join(per_class, "cls").select("key", "n", "component", "n_links")
    alone = documents.where("n = 0").select("key", "n", F.col("key").alias("component"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")
