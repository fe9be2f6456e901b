"""Hierarchical multi-length packing of tokenized documents."""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Context sizes, longest first; each is a power of two.
TIERS = (2048, 1024, 512, 256)
#: Tokens brought together before they are packed: the bound on what a task holds, whatever the size of its partition.
BLOCK_TOKENS = 2_000_000
#: Tokens of a step group, in windows of the longest tier.
STEP_WINDOWS = 8

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"


class WordTokenizer:
    """Ids of whole texts by a tokenizers file whose words never cross white space; ids of words are remembered.

    The file's tokenizer drops white space and treats what stands between white space alone, so a text's ids are those of
    its parts in turn. Texts in which that could fail (special-token strings; control characters that Python, but not the
    tokenizer, takes for white space) are encoded in one piece. At most twice ``remember`` words are kept,
    and those of one text.
    """

    def __init__(self, path: str, remember: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("[\x1c-\x1f]" + "".join(f"|{re.escape(t.content)}" for t in self.tokenizer.get_added_tokens_decoder().values()))
        #: Where no character above Latin Extended-B stands, lower case can come first (no combining mark can join a letter
        #: it lowered), and stops after a letter are a part of their own: fewer different parts have to be remembered.
        self.wide = re.compile("[^\x00-\u024f]")
        self.stops = re.compile(r"(?<=[a-zß-öø-ÿ])([.,;:!?]+)(?!\S)")
        self.remember, self.new, self.old = remember, {}, {}

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens (null: none)."""
        for text in texts:
            if not text:
                yield b""
            elif self.special.search(text):
                yield _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                words = (text if self.wide.search(text) else self.stops.sub(r" \1", text.lower())).split()
                if len(self.new) > self.remember:
                    self.old, self.new = self.new, {}
                self._learn(set(words).difference(self.new))
                yield b"".join(map(self.new.__getitem__, words))

    def _learn(self, words: set[str]) -> None:
        unknown = []
        for word in words:
            if (known := self.old.get(word)) is not None:
                self.new[word] = known
            else:
                unknown.append(word)
        if unknown:
            for word, got in zip(unknown, self.tokenizer.encode_batch_fast(unknown, add_special_tokens=False), strict=True):
                self.new[word] = _bytes(got.ids)


def _bytes(ids: list[int]) -> bytes:
    """As little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each token once; every one has a power of two of tokens.

    Whole longest windows are cut from long documents first. What remains of a document goes to the smallest tier that
    holds it. Tiers are packed from the longest: a window starts with the longest waiting remainder of its tier, then
    takes, as long as it has room, the longest remainder of shorter tiers that fits, and, when none fits, a part of the
    shortest one that is left. Remainders of the last, unfilled windows are cut at powers of two.
    """
    longest = tiers[0]
    sequences: list[list[tuple[int, int, int]]] = []
    routed: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        sequences.extend([(doc, s, longest)] for s in range(0, whole, longest))
        if n > whole:
            routed[min(t for t in tiers if t >= n - whole)].append((n - whole, doc, whole))
    waiting = sorted(x for t in tiers for x in routed[t])  # by length: a tier is a range of it
    open_pieces: list[tuple[int, int, int]] = []
    for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
        while waiting and waiting[-1][0] > below:
            n, doc, start = waiting.pop()
            window, room = [(doc, start, n)], tier - n
            while room and waiting:
                at = bisect_right(waiting, (room, len(lengths), 0)) - 1
                n, doc, start = waiting.pop(max(at, 0))
                if n > room:  # the shortest one is longer than the gap: its front fills it
                    _put(waiting, (n - room, doc, start + room))
                    n = room
                window.append((doc, start, n))
                room -= n
            if room:
                open_pieces.extend(window)
            else:
                sequences.append(window)
    left = sum(n for _, _, n in open_pieces)
    sizes = [longest] * (left // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if left % longest >> b & 1]
    pieces = iter(open_pieces)
    doc = start = n = 0
    for size in sizes:
        window = []
        while size:
            if not n:
                doc, start, n = next(pieces)
            cut = min(n, size)
            window.append((doc, start, cut))
            start, n, size = start + cut, n - cut, size - cut
        sequences.append(window)
    return sequences


def _put(waiting: list[tuple[int, int, int]], piece: tuple[int, int, int]) -> None:
    waiting.insert(bisect_right(waiting, piece), piece)


def pack_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenize whole texts, add ``end_id`` to each and pack all ids into sequences of at most the longest tier.

    Returns per piece: the key, start and length (in its document's ids), ids_crc32 (little-endian 32-bit ids),
    doc_tokens, sequence_id, offset (from 0, without gaps), window (the sequence's tokens, a power of two: nothing is
    padded) and step_group (groups of a block have the same number of tokens, but for the block's last). Null and empty
    texts have the end id alone. Null or repeated keys are packed as they are; an empty table gives no rows; other columns
    are ignored.

    Rows aren't shuffled: each task packs blocks of ``block_tokens`` of its own rows; a block ends with at most
    eleven short sequences. A document longer than a block is a block of its own.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers must be powers of two, longest first")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.spark_partition_id().cast("long").alias("p"))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {PIECES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared_tokenizer(tokenizer_path)
        end = _bytes([end_id])
        keys, bodies, held, sequence, step, part = [], [], 0, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py() << 32
            for key_value, ids in zip(batch.column(0), tokenizer.ids(text.as_py() for text in batch.column(1)), strict=True):
                keys.append(key_value)
                bodies.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= block_tokens:
                    out, sequence, step = _block(keys, bodies, tiers, part, sequence, step, batch.schema.field(0).type, key)
                    yield out
                    keys, bodies, held = [], [], 0
        if keys:
            yield _block(keys, bodies, tiers, part, sequence, step, keys[0].type, key)[0]
        keys, bodies = [], []
        give_back()

    return rows.mapInArrow(run, schema)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def shared_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file, with the words that earlier tasks met."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    keep("packing", _TOKENIZERS.clear)
    return _TOKENIZERS[path]


def _block(keys: list, bodies: list[bytes], tiers: tuple[int, ...], part: int, sequence: int, step: int, key_type: pa.DataType, key: str) -> tuple[pa.RecordBatch, int, int]:
    lengths = [len(b) // 4 for b in bodies]
    packed = sorted(pack(lengths, tiers), key=lambda w: -sum(n for _, _, n in w))
    names, rows = [], {c.split()[0]: [] for c in PIECES.split(", ")}
    filled, capacity = 0, tiers[0] * STEP_WINDOWS
    for window in packed:  # sizes are powers of two and fall: groups fill up without a remainder
        total, offset = sum(n for _, _, n in window), 0
        for doc, start, n in window:
            names.append(keys[doc])
            for c, v in zip(rows, (start, n, zlib.crc32(bodies[doc][4 * start : 4 * (start + n)]), lengths[doc], part + sequence, offset, total, part + step + filled // capacity), strict=True):
                rows[c].append(v)
            offset += n
        filled += total
        sequence += 1
    arrays = [pa.array([k.as_py() for k in names], type=key_type), *(pa.array(v, type=pa.int64()) for v in rows.values())]
    return pa.RecordBatch.from_arrays(arrays, names=[key, *rows]), sequence, step + -(-filled // capacity)
