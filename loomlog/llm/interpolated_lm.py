"""Language-model scores by deleted interpolation: n-gram estimates mixed by the frequency of their context.

Counts never meet on the driver, and no vocabulary is broadcast. Documents are encoded in blocks; a block asks the owners of
its distinct n-grams (hash buckets) for their counts in the whole corpus, and gets them back as arrays in the order asked.
What moves is one hash for each distinct n-gram of a block, not one for each token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, frozen, parallelism
from .shingles import concatenated, forget, mixed, word_hashes

#: The longest n-gram.
ORDER = 2
#: Folds by the key's crc32: 0 is scored only, 1 is held out to learn the mixture, all but 0 are counted in the end.
FOLDS = 10
#: Tokens of a block: what a task holds at a time.
BLOCK_TOKENS = 2_000_000
#: Context-frequency buckets (powers of two) and steps of expectation-maximisation.
BUCKETS, STEPS = 24, 12
#: Additive smoothing of the base score.
BASE = 0.1

#: Stand for the end of a text and for what is before its first word (no word hashes are equal but by chance).
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _pressed(array: np.ndarray) -> bytes:
    """Compressed, the numbers' first bytes first, then their second ones and so on: small numbers get short."""
    planes = np.ascontiguousarray(np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpressed(blob: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


@dataclass
class Block:
    """Whole texts, each with its end: distinct words' hashes, the number of each token's word, tokens of each text."""

    words: np.ndarray
    which: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Block:
        """Words are numbered by falling count."""
        words, which, counts = np.unique(concatenated(texts, np.uint64), return_inverse=True, return_counts=True)
        by = np.argsort(-counts, kind="stable")
        number = np.empty(len(by), "<u4")
        number[by] = np.arange(len(by))
        return cls(words[by], number[which], np.asarray([len(t) for t in texts], np.int64))

    @property
    def first(self) -> np.ndarray:
        """Tokens of the same text before each token."""
        return np.arange(len(self.which)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1-grams to ``order``-grams: distinct hashes, and each token's number among them (of the n-gram that ends there).

        What is before a text's start counts as START words.
        """
        yield self.words, self.which
        tokens, first = self.words[self.which], self.first
        run = tokens
        for k in range(1, order):
            back = np.full(len(tokens), START)
            inside = first >= k
            back[inside] = tokens[np.flatnonzero(inside) - k]
            run = mixed(run * _PAIR + back + np.uint64(k))
            yield np.unique(run, return_inverse=True)


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which n-grams are asked for, by bucket, and where each bucket starts in it."""
    bucket = (hashes % np.uint64(buckets)).astype(np.uint32)
    by = np.lexsort((hashes, bucket))
    return by, np.searchsorted(bucket[by], np.arange(buckets + 1))


class Answers:
    """Counts of a block's n-grams in the corpus: ``deleted`` without the held-out fold, or all."""

    def __init__(self, block: Block, order: int, buckets: int, replies: pd.DataFrame, totals: dict, deleted: bool):
        self.n, self.v, texts = (totals[k] for k in (("n_less", "v_less", "texts_less") if deleted else ("n", "v", "texts")))
        column = "less" if deleted else "counts"
        self.counts, start = [], block.first == 0
        self.context = [np.full(len(block.which), self.n)]
        for k, (hashes, which) in enumerate(block.grams(order)):
            by, cuts = dealt(hashes, buckets)
            counts = np.zeros(len(hashes), np.int64)
            mine, there = replies[replies["k"] == k], 0
            for bucket, blob in zip(mine["bucket"], mine[column], strict=True):
                got = _unpressed(blob, "<u4")
                if len(got) != cuts[bucket + 1] - cuts[bucket]:
                    raise RuntimeError("a block was not encoded as before")
                counts[by[cuts[bucket] : cuts[bucket + 1]]] = got
                there += len(got)
            if there != len(hashes):
                raise RuntimeError("counts of a block are missing")
            counts = counts[which]
            self.counts.append(counts)
            # the context of the next longer n-gram is this one, a token earlier; before a text's first word: every text
            self.context.append(np.where(start, texts, np.r_[np.zeros(min(1, len(counts)), np.int64), counts[:-1]]))
        self.context.pop()

    def bucket(self) -> np.ndarray:
        """Of each token's longest context, by the power of two of its frequency."""
        return np.minimum(np.log2(self.context[-1] + 1.0), BUCKETS - 1).astype(np.int64)

    def parts(self) -> np.ndarray:
        """Estimates of each token: uniform, then by 1-grams and longer ones; in an unknown context, the next shorter one's."""
        out = [np.full(len(self.counts[0]), 1.0 / (self.v + 1))]
        for c, x in zip(self.counts, self.context, strict=True):
            out.append(np.where(x > 0, c / np.maximum(x, 1), out[-1]))
        return np.stack(out, 1)


def _encoded(docs: DataFrame, key: str, text: str, block_tokens: int) -> DataFrame:
    """Blocks: block (number), part (fold 1 or not), keys, folds, sizes, words (distinct hashes), which (each token's word)."""
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), fold(docs[key], FOLDS).alias("fold"), F.col(text).alias("text"), F.spark_partition_id().cast("long").alias("p"))
    names = ["block", "held", "keys", "folds", "sizes", "words", "which"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_arrow, made, part = None, 0, 0
        held: dict[bool, list] = {True: [], False: []}
        sizes = {True: 0, False: 0}

        def passed(which: bool) -> pa.RecordBatch:
            nonlocal made
            some = held[which]
            block = Block.of([x[2] for x in some])
            row = [
                pa.array([part + made], pa.int64()),
                pa.array([which], pa.bool_()),
                pa.array([[x[0] for x in some]], pa.list_(key_arrow)),
                pa.array([np.asarray([x[1] for x in some], "<u1").tobytes()], pa.binary()),
                pa.array([block.sizes.astype("<u4").tobytes()], pa.binary()),
                pa.array([_pressed(block.words)], pa.binary()),
                pa.array([_pressed(block.which)], pa.binary()),
            ]
            made += 1
            held[which], sizes[which] = [], 0
            return pa.RecordBatch.from_arrays(row, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key_arrow, part = batch.schema.field(0).type, batch.column(3)[0].as_py() << 32
            for k, number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = np.append(word_hashes(body.as_py() or ""), END)
                which = number == 1
                held[which].append((k, number, tokens))
                sizes[which] += len(tokens)
                if sizes[which] >= block_tokens:
                    yield passed(which)
        forget()
        for which in (True, False):
            if held[which]:
                yield passed(which)

    return rows.mapInArrow(run, f"block long, held boolean, keys array<{key_type}>, folds binary, sizes binary, words binary, which binary")


def _block(row: dict) -> Block:
    return Block(_unpressed(row["words"], "<u8"), _unpressed(row["which"], "<u4"), np.frombuffer(row["sizes"], "<u4").astype(np.int64))


def _requests(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, block, k, hashes, less, counts): a block's n-grams, how often they are in its texts outside folds 0 and 1, and outside fold 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, folds = _block(row), np.frombuffer(row["folds"], "<u1")
                scored = np.repeat(folds == 0, block.sizes)
                out: dict[str, list] = {n: [] for n in ("bucket", "block", "k", "hashes", "less", "counts")}
                for k, (hashes, which) in enumerate(block.grams(order)):
                    by, cuts = dealt(hashes, buckets)
                    counts = np.bincount(which[~scored], minlength=len(hashes)).astype("<u4")[by]
                    hashes = hashes[by]
                    less = np.zeros_like(counts) if row["held"] else counts
                    for b in range(buckets):
                        s = slice(cuts[b], cuts[b + 1])
                        if s.start < s.stop:
                            for n, v in (("bucket", b), ("block", row["block"]), ("k", k), ("hashes", _pressed(np.diff(hashes[s], prepend=np.uint64(0)))), ("less", _pressed(less[s])), ("counts", _pressed(counts[s]))):
                                out[n].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["block"], pa.int64()), pa.array(out["k"], pa.int32()), *(pa.array(out[n], pa.binary()) for n in ("hashes", "less", "counts"))], names=list(out))

    return blocks.mapInArrow(run, "bucket int, block long, k int, hashes binary, less binary, counts binary")


def _replies(requests: DataFrame) -> DataFrame:
    """(bucket, block, k, less, counts) for the requests, summed over all blocks; a bucket's totals have block null."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        bucket, out = int(part["bucket"].iloc[0]), []
        for k, some in part.groupby("k"):
            hashes = [np.cumsum(_unpressed(x, "<u8"), dtype=np.uint64) for x in some["hashes"]]
            known, which = np.unique(np.concatenate(hashes), return_inverse=True)
            totals = [np.bincount(which, np.concatenate([_unpressed(x, "<u4") for x in some[c]]), len(known)) for c in ("less", "counts")]
            cuts = np.cumsum([0, *map(len, hashes)])
            for i, block in enumerate(some["block"]):
                mine = which[cuts[i] : cuts[i + 1]]
                out.append((bucket, block, int(k), *(_pressed(np.minimum(t[mine], 2**32 - 1).astype("<u4")) for t in totals), None, None, None, None))
            if k == 0:
                out.append((bucket, None, 0, None, None, *(int(x) for t in totals for x in (t.sum(), (t > 0).sum()))))
        frame = pd.DataFrame(out, columns=["bucket", "block", "k", "less", "counts", "n_less", "v_less", "n", "v"])
        for c in ("block", "n_less", "v_less", "n", "v"):
            frame[c] = frame[c].astype("Int64")
        return frame

    return requests.groupBy("bucket").applyInPandas(run, "bucket int, block long, k int, less binary, counts binary, n_less long, v_less long, n long, v long")


def learn_weights(events: DataFrame, order: int, steps: int = STEPS) -> np.ndarray:
    """Mixture weights (BUCKETS x order + 1) that maximise the likelihood of held-out events.

    events: rows of arrays (bucket u1, count u4, parts f8 by event). A step sums posteriors over all rows; the sums (24
    buckets of 3 numbers, whatever the input) give the next weights. A bucket leans on the weights of all buckets together by
    one event's worth, so that it has some without events of its own.
    """
    weights = np.full((BUCKETS, order + 1), 1.0 / (order + 1))

    for _ in range(steps):
        current = weights

        def run(batches: Iterator[pa.RecordBatch], current: np.ndarray = current) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS, order + 1))
            for batch in batches:
                for row in batch.to_pylist():
                    bucket, count = _unpressed(row["bucket"], "<u1").astype(np.int64), _unpressed(row["count"], "<u4")
                    parts = _unpressed(row["parts"], "<f8").reshape(-1, order + 1) * current[bucket]
                    parts *= (count / np.maximum(parts.sum(1), 1e-300))[:, None]
                    for c in range(order + 1):
                        total[:, c] += np.bincount(bucket, parts[:, c], BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(BUCKETS), order + 1), pa.int32()), pa.array(np.tile(np.arange(order + 1), BUCKETS), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["b", "c", "x"])

        sums = np.zeros((BUCKETS, order + 1))
        for row in events.mapInArrow(run, "b int, c int, x double").groupBy("b", "c").agg(F.sum("x").alias("x")).collect():
            sums[row["b"], row["c"]] = row["x"]
        if not sums.sum():
            break
        pooled = np.maximum(sums.sum(0) / sums.sum(), 1e-6)
        weights = sums + pooled / pooled.sum()
        weights = np.maximum(weights / weights.sum(1, keepdims=True), 1e-9)
        weights /= weights.sum(1, keepdims=True)
    return weights


def events_of(answers: Answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct (bucket, estimates) and how often they occur."""
    keyed = np.column_stack([answers.bucket().astype(float), answers.parts()])
    order = np.lexsort(keyed.T)
    keyed = keyed[order]
    new = np.r_[True, (keyed[1:] != keyed[:-1]).any(1)]
    counts = np.diff(np.r_[np.flatnonzero(new), len(keyed)])
    keyed = keyed[new]
    return keyed[:, 0].astype("<u1"), counts.astype("<u4"), keyed[:, 1:]


def interpolated_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the whole text).

    Words are what the six ASCII white-space characters separate, A-Z in lower case; a text ends with an end token. Documents
    outside fold 0 (by the key's crc32) are learned from: their n-grams are counted without fold 1, mixture weights are
    learned on fold 1, and then both are counted. A token's probability is the mixture, by the frequency bucket of its
    longest context, of the relative frequencies of its n-grams and a uniform one over all known words and an unknown one.
    Null and empty texts have the end alone. Repeated rows are counted and scored as often as they occur; null keys fall
    into the fold of the text "null"; an empty table gives no rows; an estimate in an unknown context is that of the next
    shorter n-gram, so that probabilities of all words and an unknown one sum to one; without documents to learn from all
    estimates are uniform. Words are told apart by 64-bit hashes.
    """
    key_type = docs.schema[key].dataType.simpleString()
    buckets = 4 * parallelism(docs)
    blocks = frozen(_encoded(docs, key, text, block_tokens))
    replies = frozen(_replies(_requests(blocks, order, buckets)))
    row = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_less", "v_less", "n", "v")]).first()
    folds = docs.select(fold(docs[key], FOLDS).alias("f")).agg(F.coalesce(F.sum((F.col("f") > 1).cast("long")), F.lit(0)).alias("texts_less"), F.coalesce(F.sum((F.col("f") > 0).cast("long")), F.lit(0)).alias("texts")).first()
    totals = row.asDict() | folds.asDict()
    answers = replies.where("block is not null").select("bucket", "block", "k", "less", "counts")

    def events(block_rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in block_rows.to_dict("records"):
            bucket, count, parts = events_of(Answers(_block(row), order, buckets, got, totals, deleted=True))
            out.append((_pressed(bucket), _pressed(count), _pressed(parts)))
        return pd.DataFrame(out, columns=["bucket", "count", "parts"])

    held = blocks.where("held").groupBy("block").cogroup(answers.drop("counts").join(blocks.where("held").select("block"), "block", "left_semi").groupBy("block"))
    weights = learn_weights(frozen(held.applyInPandas(events, "bucket binary, count binary, parts binary")), order)

    def scores(block_rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in block_rows.to_dict("records"):
            block, folds = _block(row), np.frombuffer(row["folds"], "<u1")
            found = Answers(block, order, buckets, got, totals, deleted=False)
            n, v = totals["n"], totals["v"]
            starts = np.cumsum(block.sizes) - block.sizes
            model = np.log10((found.parts() * weights[found.bucket()]).sum(1))
            base = np.log10((found.counts[0] + BASE) / (n + BASE * (v + 1)))
            sums = [np.add.reduceat(x, starts) for x in ((found.counts[0] > 0).astype(np.int64), base, model)]
            out.append(pd.DataFrame({"key": pd.Series(list(row["keys"]), dtype=object), "held_out": folds == 0, "n_tokens": block.sizes, "n_known": sums[0], "train_tokens": n, "base_score": sums[1], "score": sums[2]}))
        return pd.concat(out)

    scored = blocks.groupBy("block").cogroup(answers.drop("less").groupBy("block")).applyInPandas(scores, f"key {key_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("key", key)
