"""Language identification of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, frozen, give_back, make_room

#: Hashed features of affixes and n-grams.
DIMENSIONS = 1 << 16
#: Labelled documents to learn from, of each language those with the smallest hashes of text. This bounds training, whatever the input.
TRAIN_DOCUMENTS = 3_000
#: Sequences cut from them, and the words that each of their parts may have.
SEQUENCES, PART = 8_000, (3, 18)
#: Words of a language's lexicon: its most frequent ones in the sample.
LEXICON = 400
#: Letters of a word that is labelled as one; a longer word is labelled in pieces. What tells a piece: no text has it.
WIDTH, PIECE = 24, "\ud800"
#: Words labelled at a time, and remembered words of a task.
CHUNK_WORDS, REMEMBER = 150_000, 300_000

_EDGES = string.punctuation + string.digits + "«»“”„‘’…–—¿¡"


@dataclass
class Model:
    """languages, feature weights (DIMENSIONS x L), lexicon (word to row of lexicon_weights), transitions, start scores."""

    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


def cuts(word: str) -> list[str]:
    """A word, or a longer one's letters in runs of nearly equal length."""
    body = core(word) if len(word) > WIDTH else ""
    if len(body) <= WIDTH:
        return [word]
    n = -(-len(body) // (WIDTH - 2))
    return [body[i * len(body) // n : (i + 1) * len(body) // n] for i in range(n)]


def pieces(words: list[str]) -> list[str]:
    """Words, longer ones in consecutive pieces: each with the three letters after it, so that no n-gram is lost, and the word's edges."""
    if not words or max(map(len, words)) <= WIDTH:
        return words
    out = []
    for word in words:
        runs = cuts(word)
        if len(runs) == 1:
            out.append(word)
            continue
        for i, run in enumerate(runs):
            out.append(PIECE + ("" if i else "\x02") + run + (runs[i + 1][:3] if i + 1 < len(runs) else "\x03"))
    return out


def core(word: str) -> str:
    """A word without what isn't letters at its edges; "" if it has no letter. Pieces stay whole."""
    if word[:1] != PIECE:
        word = word.strip(_EDGES)
    return word if word.isalpha() or any(map(str.isalpha, word)) else ""


def features(words: list[str]) -> np.ndarray:
    """Hashed features of words, one row each: n-grams of 1 to 4 letters with word edges marked; -1 where there is none.

    N-grams that touch an edge are the word's affixes; as the edge is part of them, they have features of their own.
    """
    marked = [w[1:] if w[:1] == PIECE else f"\x02{w}\x03" for w in words]
    letters = np.array(marked, dtype=f"U{WIDTH + 2}").view(np.uint32).reshape(len(words), WIDTH + 2).astype(np.uint64)
    there = letters > 0
    rolled, columns = np.zeros_like(letters), []
    for n in range(1, 5):
        end = letters.shape[1] - n + 1
        rolled = rolled[:, :end] * np.uint64(0x100000001B3) + letters[:, n - 1 :]
        mixed = (rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        columns.append(np.where(there[:, n - 1 :], (mixed >> np.uint64(48)).astype(np.int64) & (DIMENSIONS - 1), -1))
    return np.concatenate(columns, axis=1).astype(np.int32)


def emissions(model: Model, words: list[str]) -> np.ndarray:
    """Scores of each language for each word's core; a word without letters favours none."""
    out = np.zeros((len(words), len(model.languages)))
    for at in range(0, len(words), 20_000):
        part = words[at : at + 20_000]
        cores = [core(w) for w in part]
        index = features(cores)
        there = index >= 0
        scale = 1 / np.sqrt(np.maximum(there.sum(1), 1))
        padded = np.vstack([model.weights, np.zeros((1, len(model.languages)))])  # row -1 is nothing
        rows = np.zeros((len(part), len(model.languages)))
        for column in index.T:
            rows += padded[column]
        rows *= scale[:, None]
        known = np.fromiter((model.lexicon.get(c, -1) for c in cores), np.int64, len(cores))
        rows[known >= 0] += model.lexicon_weights[known[known >= 0]]
        rows[np.fromiter((not c for c in cores), bool, len(cores))] = 0
        out[at : at + len(part)] = rows
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word's label, and expected transitions (L x L, summed); the words of a sequence follow each other.

    All sequences advance together, longest first, so that step t works on those that still have a word t.
    """
    n, labels = scores.shape
    marginals, moves = np.zeros((n, labels)), np.zeros((labels, labels))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return marginals, moves
    first = (np.cumsum(lengths) - lengths)[order]
    long = lengths[order]
    active = np.searchsorted(-long, -np.arange(long[0]), side="left")  # sequences with a word t
    local = np.exp(scores - scores.max(1, keepdims=True))
    step, alpha = np.exp(transitions), np.zeros((n, labels))
    now = local[first] * np.exp(start - start.max())
    alpha[first] = now = now / now.sum(1, keepdims=True)
    for t in range(1, long[0]):
        at = first[: active[t]] + t
        now = (now[: active[t]] @ step) * local[at]
        now /= now.sum(1, keepdims=True)
        alpha[at] = now
    beta = np.ones((len(order), labels))
    for t in range(long[0] - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        both = alpha[at] * beta[:k]
        marginals[at] = both / both.sum(1, keepdims=True)
        if t:
            back = local[at] * beta[:k]
            before = alpha[at - 1]
            norm = np.einsum("ki,ij,kj->k", before, step, back)
            moves += step * (before.T @ (back / norm[:, None]))
            back = back @ step.T
            beta[:k] = back / back.sum(1, keepdims=True)
    return marginals, moves


def sequences(texts: list[tuple[str, int]], count: int, seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Code-switched training sequences: (words, labels, lengths). Parts of documents, of mixed languages, are joined.

    A labelled document has one language, so its words alone would teach that languages never change.
    """
    rng = np.random.default_rng(seed)
    by: dict[int, list[list[str]]] = {}
    for text, label in texts:
        if len(words := pieces(text.lower().split())) >= PART[0]:
            by.setdefault(label, []).append(words)
    words_out, labels_out, lengths = [], [], []
    present = sorted(by)
    for _ in range(count if present else 0):
        total = 0
        for _ in range(int(rng.integers(1, 4))):
            label = present[int(rng.integers(len(present)))]
            words = by[label][int(rng.integers(len(by[label])))]
            size = int(rng.integers(PART[0], PART[1] + 1))
            begin = int(rng.integers(max(1, len(words) - size + 1)))
            part = words[begin : begin + size]
            words_out += part
            labels_out += [label] * len(part)
            total += len(part)
        lengths.append(total)
    return words_out, np.asarray(labels_out, np.int64), np.asarray(lengths, np.int64)


def train(texts: list[tuple[str, str]], epochs: int = 4, batch: int = 250, rate: float = 0.15, penalty: float = 1e-5) -> Model | None:
    """Maximise the conditional likelihood of code-switched sequences by adaptive gradient steps; None without examples."""
    languages = sorted({lang for _, lang in texts})
    number = {lang: i for i, lang in enumerate(languages)}
    words, labels, lengths = sequences([(t, number[lang]) for t, lang in texts], SEQUENCES)
    if not words:
        return None
    size = len(languages)
    counts = [Counter() for _ in languages]
    for word, label in zip(words, labels, strict=True):
        counts[label][core(word)] += 1
    lexicon: dict[str, int] = {}
    for c in counts:
        for word, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if word and n > 2 and word[0] != PIECE:
                lexicon.setdefault(word, len(lexicon))
    model = Model(languages, np.zeros((DIMENSIONS, size)), lexicon, np.zeros((len(lexicon), size)), np.zeros((size, size)), np.zeros(size))
    distinct, which = np.unique(np.asarray(words, dtype=object), return_inverse=True)
    cores = [core(w) for w in distinct]
    index = features(cores)
    scale = 1 / np.sqrt(np.maximum((index >= 0).sum(1), 1))
    known = np.fromiter((lexicon.get(c, -1) for c in cores), np.int64, len(cores))
    lettered = np.fromiter((bool(c) for c in cores), bool, len(cores))
    begin = np.cumsum(lengths) - lengths
    sums = [np.full(x.shape, 1e-8) for x in (model.weights, model.lexicon_weights, model.transitions, model.start)]
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(lengths))
        for some in np.array_split(order, max(1, len(order) // batch)):
            at = np.concatenate([np.arange(begin[s], begin[s] + lengths[s]) for s in some])
            used, place = np.unique(which[at], return_inverse=True)
            flat, owner = index[used], np.repeat(np.arange(len(used)), index.shape[1])
            keep = (flat.ravel() >= 0) & lettered[used][owner]
            flat, owner = flat.ravel()[keep], owner[keep]
            local = np.zeros((len(used), size))
            for k in range(size):
                local[:, k] = np.bincount(owner, model.weights[flat, k], len(used)) * scale[used]
            listed = known[used] >= 0
            local[listed] += model.lexicon_weights[known[used][listed]]
            marginals, moves = forward_backward(local[place], lengths[some], model.transitions, model.start)
            heads = np.cumsum(lengths[some]) - lengths[some]
            gold = np.zeros_like(marginals)
            gold[np.arange(len(at)), labels[at]] = 1
            inner = np.ones(len(at), bool)
            inner[heads] = False
            told = np.zeros_like(moves)
            np.add.at(told, (labels[at][:-1][inner[1:]], labels[at][1:][inner[1:]]), 1)
            gap = gold - marginals
            word_gap = np.stack([np.bincount(place, gap[:, k], len(used)) for k in range(size)], 1)
            slopes = [
                np.stack([np.bincount(flat, word_gap[owner, k] * scale[used][owner], DIMENSIONS) for k in range(size)], 1) - penalty * len(some) * model.weights,
                np.stack([np.bincount(known[used][listed], word_gap[listed, k], len(lexicon)) for k in range(size)], 1) - penalty * len(some) * model.lexicon_weights,
                told - moves,
                gap[heads].sum(0),
            ]
            for x, total, slope in zip((model.weights, model.lexicon_weights, model.transitions, model.start), sums, slopes, strict=True):
                total += slope**2
                x += rate * slope / np.sqrt(total)
    model.weights, model.lexicon_weights = model.weights.astype(np.float32), model.lexicon_weights.astype(np.float32)
    return model


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", documents: int = TRAIN_DOCUMENTS) -> Model | None:
    """Train on at most ``documents`` labelled texts: of each language those with the smallest hashes, dealt in turn.

    So a rare language is learned, too, and languages with few texts leave their places to others; of more languages than
    ``documents``, the commonest. Rows without text or language take no part; a text with several languages counts for the
    first by name. Samples are chosen on hashes alone; only their texts are fetched.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(text), F.lit(3)).alias("h"))
    kinds = frozen(labelled.groupBy("h").agg(F.min("l").alias("l")))
    counts = kinds.groupBy("l").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "l").limit(documents)
    # of a common language about twice as many hashes as can be asked for: a window never meets more
    low = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * documents + 1_000) / F.col("c"))
    few = kinds.join(F.broadcast(counts), "l").where(F.col("h").cast("double") <= low)
    turns = few.withColumn("turn", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("turn") <= documents)
    chosen = turns.orderBy("turn", "h").limit(documents).select("h")
    sample = labelled.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min(F.struct("l", "t")).alias("x")).select("x.t", "x.l", "h").collect()
    return train([(r["t"], r["l"]) for r in sorted(sample, key=lambda r: r["h"])]) if sample else None


class Labeller:
    """Marginals of whole texts; scores of words are remembered within a task."""

    def __init__(self, model: Model):
        self.model, self.number = model, {}
        self.scores = np.zeros((0, len(model.languages)))
        self.lettered = np.zeros(0, bool)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > REMEMBER:
            self.number = {}
            self.scores, self.lettered = self.scores[:0], self.lettered[:0]
        number = self.number
        fresh = list(set(words).difference(number))
        if fresh:
            number.update(zip(fresh, range(len(number), len(number) + len(fresh)), strict=True))
            self.scores = np.vstack([self.scores, emissions(self.model, fresh)])
            self.lettered = np.concatenate([self.lettered, np.fromiter((bool(core(w)) for w in fresh), bool, len(fresh))])
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """(word, language, marginal) of a text's words, long ones in pieces; one without letters has language ``und``."""
        words, shown, lengths = [], [], []
        for line in text.lower().split("\n"):
            words += (line_words := pieces(line.split()))
            shown += [x for w in line.split() for x in cuts(w)]
            lengths.append(len(line_words))
        which = self._numbers(words)
        marginals, _ = forward_backward(self.scores[which], np.asarray(lengths), self.model.transitions, self.model.start)
        return [(w, self.model.languages[m.argmax()], float(m.max())) if self.lettered[i] else (w, "und", 0.0) for w, i, m in zip(shown, which, marginals, strict=True)]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of marginals over each text's words with letters (texts x L), and how many such words there are.

        Lines are the sequences. Texts are taken together up to CHUNK_WORDS words.
        """
        sums, known = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts))
        words, lengths, owners = [], [], []
        for i, text in enumerate(texts):
            for line in (text or "").lower().split("\n"):
                if line_words := pieces(line.split()):
                    words += line_words
                    lengths.append(len(line_words))
                    owners.append(i)
            if words and (len(words) >= CHUNK_WORDS or i == len(texts) - 1):
                self._add(words, lengths, owners, sums, known)
                words, lengths, owners = [], [], []
        if words:
            self._add(words, lengths, owners, sums, known)
        return sums, known

    def _add(self, words: list[str], lengths: list[int], owners: list[int], sums: np.ndarray, known: np.ndarray) -> None:
        which, sizes = self._numbers(words), np.asarray(lengths)
        marginals, _ = forward_backward(self.scores[which], sizes, self.model.transitions, self.model.start)
        owner, lettered = np.repeat(np.asarray(owners), sizes), self.lettered[which]
        for k in range(sums.shape[1]):
            sums[:, k] += np.bincount(owner, marginals[:, k] * lettered, len(sums))
        known += np.bincount(owner, lettered, len(sums))


def language_column(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """struct(lang_pred, score): the language with the most words in expectation, and its share of them (0 to 1).

    ``und`` with score 0 if the text is null or has no letter, or if there was nothing to learn from. Equal sums go to the
    first language by name.
    """
    if model is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make_room()
        labeller = Labeller(shipped.value)  # what it remembers goes with the task
        for batch in batches:
            sums, known = labeller.texts(batch.to_pylist())
            best = sums.argmax(1) if len(sums) else np.zeros(0, int)
            top = np.clip(sums[np.arange(len(best)), best] / np.maximum(known, 1), 0, 1)
            names = [labeller.model.languages[b] if n else "und" for b, n in zip(best, known, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(known > 0, top, 0.0), pa.float64())], names=["lang_pred", "score"])
        del labeller
        give_back()

    return identify(F.col(text))


def identify_languages(docs: DataFrame, learn_from: DataFrame | None = None, text: str = "text", lang: str = "lang", name: str = "language") -> DataFrame:
    """Add the struct column ``name`` (lang_pred, score) to docs, by a model learned from ``learn_from`` (default: docs).

    Every word of a text is labelled by forward-backward along its line, a word of more than WIDTH letters in pieces that
    are all labelled and counted; only the text is looked at. Null and empty
    texts are ``und``; equal texts get equal results, but for the order of sums; an empty table gives no rows; a column
    called ``name`` is replaced.
    """
    model = learn(docs if learn_from is None else learn_from, text, lang)
    return docs.withColumn(name, language_column(docs, model, text))


def held_out(docs: DataFrame, key: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept from learning: the crc32 of its key's text is a multiple of ``folds``."""
    return fold(docs[key], folds) == 0
