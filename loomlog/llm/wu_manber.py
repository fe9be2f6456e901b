"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every byte but digits, letters and bytes from 0x80 on ends a word; A-Z become a-z.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

#: Test strings searched at a time. A block's tables are shipped to the executors, so their size must be bounded.
BLOCK_BYTES = 32 << 20

SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:long,length:long>>"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes; null has none."""
    return text.translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], width: int) -> Iterator[tuple[bytes, ...]]:
    """Each run of ``width`` words, or all words if there are fewer (none: nothing)."""
    if 0 < len(words) <= width:
        yield tuple(words)
    else:
        for i in range(len(words) - width + 1):
            yield tuple(words[i : i + width])


class Patterns:
    """Wu-Manber tables for patterns of one length, words being the alphabet and ``min(2, length)`` words a block.

    ``shift`` has, for each block of a pattern, how far the search may move when that block ends the window; a block
    that no pattern has allows the longest move. Where it is 0, the bucket of the window's last block and first word
    has the few patterns that direct comparison then decides.
    """

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple[str, ...]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - 2 : end] if self.block == 2 else words[end - 1]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets[(words[0], words[length - self.block : length])].append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(start, items) of each occurrence, by start."""
        length, far, get, two = self.length, self.far, self.shift.get, self.block == 2
        end, n, tail = length, len(words), length - self.block
        while end <= n:
            step = get((words[end - 2], words[end - 1]) if two else words[end - 1], far)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in self.buckets.get((words[start], tuple(words[start + tail : end])), ()):
                if words[start:end] == pattern:
                    yield start, items
            end += 1


def pattern_blocks(items: DataFrame, id_col: str, text_col: str, width: int, block_bytes: int) -> Iterator[list[Patterns]]:
    """Search tables for the items, block after block; each block holds about ``block_bytes`` of test strings.

    The items stream to the driver one partition at a time; no more than a block is kept. An item without words has no
    window. A null id counts as the id "" (its occurrences count).
    """
    found: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    held = 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("binary").alias("t"))
    for row in rows.toLocalIterator():
        for window in windows_of(words_of(bytes(row["t"]) if row["t"] is not None else None), width):
            same = found[len(window)][window]
            held += 0 if same else sum(map(len, window)) + 8 * len(window)
            same.add(row["i"])
        if held >= block_bytes:
            yield [Patterns(n, {w: tuple(ids) for w, ids in p.items()}) for n, p in sorted(found.items())]
            found.clear()
            held = 0
    if found:
        yield [Patterns(n, {w: tuple(ids) for w, ids in p.items()}) for n, p in sorted(found.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (start, end) spans, as spans apart from each other."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def mark_benchmark_overlap(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Find each occurrence of a window of ``width`` item words in whole texts.

    Returns the columns ``keep`` (default: all of docs but those named like a result) and n_words, n_hit (words inside any
    occurrence), n_items (items with an occurring window), items_sha256 (of their sorted ids, joined by commas; of no
    bytes if none), contaminated (n_hit > 0) and hit_spans (word ranges). Null and empty texts have no words; repeated
    items or rows change nothing; an empty item table hits nothing. Clashing columns of docs are left out.

    The only thing shipped to executors is one block of search tables, of ``block_bytes`` of strings; further blocks
    are further passes over the rows, which carry the spans found so far.
    """
    result = {c.split()[0] for c in SCHEMA.split(", ")}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in result]
    state = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].cast("binary").alias("body"), F.lit(None).cast("array<struct<s:long,e:long>>").alias("spans"), F.lit(None).cast("array<string>").alias("ids"), F.lit(0).cast("long").alias("n"))
    blocks = pattern_blocks(items, item_id, item_text, width, block_bytes)
    block = next(blocks, [])
    while (following := next(blocks, None)) is not None:
        state, block = _search(state, block, last=False), following
    state = _search(state, block, last=True)
    ids = F.array_sort(F.coalesce("ids", F.array().cast("array<string>")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"])
    return state.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("n").alias("n_words"), hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        F.transform("spans", lambda s: F.struct(s["s"].alias("start"), (s["e"] - s["s"]).alias("length"))).alias("hit_spans"),
    )


def _search(state: DataFrame, tables: list[Patterns], last: bool) -> DataFrame:
    """One pass over the rows; the last one leaves the texts behind."""
    shipped = state.sparkSession.sparkContext.broadcast(tables)
    out = state.drop("body").schema if last else state.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {f.name: i for i, f in enumerate(batch.schema)}
            spans_out, ids_out, n_out = [], [], []
            old = zip(batch.column(col["spans"]).to_pylist(), batch.column(col["ids"]).to_pylist(), strict=True)
            for body, (spans, ids) in zip(batch.column(col["body"]), old, strict=True):
                words = words_of(body.as_py())
                hits, seen = [(s["s"], s["e"]) for s in spans or ()], set(ids or ())
                for patterns in shipped.value:
                    for start, items in patterns.search(words):
                        if hits and hits[-1][0] <= start <= hits[-1][1]:
                            hits[-1] = (hits[-1][0], max(hits[-1][1], start + patterns.length))
                        else:
                            hits.append((start, start + patterns.length))
                        seen.update(items)
                spans_out.append([{"s": s, "e": e} for s, e in merged(hits)])
                ids_out.append(sorted(seen))
                n_out.append(len(words))
            new = {name: pa.array(values, type=batch.schema.field(name).type) for name, values in (("spans", spans_out), ("ids", ids_out), ("n", n_out))}
            names = [name for name in col if not (last and name == "body")]
            yield pa.RecordBatch.from_arrays([new.get(name, batch.column(col[name])) for name in names], names=names)

    return state.mapInArrow(run, out)


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> Column:
    """Whether a text of docs has any occurrence of an item's window; null and empty texts haven't.

    Only texts go to Python. Each block of search tables is a pass of its own, and stops at a text's first occurrence.
    """
    sc = docs.sparkSession.sparkContext

    def pass_over(block: list[Patterns]) -> Column:
        shipped = sc.broadcast(block)

        @F.arrow_udf("boolean")
        def hit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([any(next(p.search(words), None) for p in shipped.value) for words in (words_of(x.as_py()) for x in batch)], pa.bool_())

        return hit(F.col(text).cast("binary"))

    found = F.lit(False)
    for block in pattern_blocks(items, item_id, item_text, width, block_bytes):
        found = found | pass_over(block)
    return found
