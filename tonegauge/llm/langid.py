"""Language of words and texts by a linear-chain conditional random field.

A word (a run of letters, lower case) has affix features (its first and last one
to three bytes), n-gram features (two to four bytes) and a lexicon feature (the word itself, if the training rows have it
often enough); weights are learned for each label, and for each pair of
neighbouring labels a transition. Marginal probabilities of the labels come from
forward-backward over the whole text, so words of code-switched text get labels
of their own; a text's label is the one with the largest expected share of words,
and its score that share.

Every label is learned. Training rows are at most about ``PER_LABEL`` texts of each
label, picked by a hash of doc_id; of a text longer than ``MOST_CHARS`` a stretch of
that length at a hashed place is learned from. Every word has the text's label, and
pieces of two labels are spliced so that transitions between labels are seen.
Likelihood is maximised by AdaGrad steps over all pieces.

Defined results: a null text or one without letters is ``und`` with score 0; with
no labelled rows every text is; ties go to the label that sorts first; repeated
rows get equal answers; an empty table gives an empty table; further columns are
kept by ``labelled`` (but for its own output names) and by ``accept`` (all of them),
and ignored by ``train``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._common import importable, no_cycles, tidy, unused
from ._text import U64, mix

#: The most training rows of a label and characters of each, hashed features, words of a training piece, and occurrences that put a word into the lexicon.
PER_LABEL, MOST_CHARS, FEATURES, PIECE, LEXICON = 250, 100_000, 1 << 16, 32, 3
#: Bytes of texts that are labelled together, or one text.
AT_ONCE = 1_500_000
#: Distinct words whose label scores a worker keeps.
MEMO_WORDS = 250_000
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(words: list[str], lexicon: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, end to end, and where each word's begin.

    Runs of two to four bytes of ``^word$``: those at the marks are the word's affixes,
    the others its n-grams; and the word, if the lexicon has it.
    """
    marked = [f"^{w}$".encode() for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)[owner] - np.arange(len(data))  # bytes left of the word, this one included
    found, whose, run = [], [], data
    for n in (2, 3, 4):
        run = run[: len(data) - n + 1] * U64(257) + data[n - 1 :] + U64(1)
        inside = ends[: len(run)] >= n
        found.append(mix(run[inside] + U64(n << 40)) & U64(FEATURES - 1))
        whose.append(owner[: len(run)][inside])
    known = [i for i, w in enumerate(words) if w in lexicon]
    found.append(np.fromiter((zlib.crc32(words[i].encode()) & (FEATURES - 1) for i in known), np.uint64, len(known)))
    whose.append(np.array(known, np.int64))
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.searchsorted(whose[order], np.arange(len(words) + 1))


class Crf:
    """Weights: of features (FEATURES, labels), first labels, transitions (from, to)."""

    def __init__(self, labels: list[str], lexicon: set[str]):
        self.labels, self.lexicon = labels, lexicon
        n = len(labels)
        self.w, self.first, self.trans = np.zeros((FEATURES, n), np.float32), np.zeros(n), np.zeros((n, n))
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.labels)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    # -- training

    def fit(self, texts: list[tuple[str, int]], epochs: int = 6, batch: int = 512, rate: float = 0.3, seed: int = 11) -> Crf:
        vocabulary: dict[str, int] = {}
        pieces: list[tuple[list[int], int]] = []
        for text, label in texts:
            numbers = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            pieces += [(numbers[i : i + PIECE], label) for i in range(0, len(numbers), PIECE)]
        if not pieces or len(self.labels) < 2:
            return self
        names, parts, starts = list(vocabulary), [], [np.zeros(1, np.int64)]
        for at in range(0, len(names), 10_000):
            found, own = features(names[at : at + 10_000], self.lexicon)
            parts.append(found.astype(np.int32))
            starts.append(own[1:] + starts[-1][-1])
        flat, bounds = np.concatenate(parts), np.concatenate(starts)
        rng = np.random.default_rng(seed)
        n = len(self.labels)
        sum_w, sum_t, sum_f = np.full((FEATURES, n), 1e-6, np.float32), np.full((n, n), 1e-6), np.full(n, 1e-6)
        for _ in range(epochs):
            order, partner = rng.permutation(len(pieces)), rng.permutation(len(pieces))
            for at in range(0, len(order), batch):
                words, gold = np.full((min(batch, len(order) - at), PIECE), -1), np.full((min(batch, len(order) - at), PIECE), -1)
                for row, i in enumerate(order[at : at + batch]):
                    own, label = pieces[i]
                    words[row, : len(own)], gold[row, : len(own)] = own, label
                    if row % 4 == 0:  # the last part from a piece of another text: a switch where the labels differ
                        other, its = pieces[partner[at + row]]
                        cut = int(rng.integers(1, PIECE))
                        tail = other[: len(own) - cut] if cut < len(own) else []
                        words[row, cut : cut + len(tail)], gold[row, cut : cut + len(tail)] = tail, its
                self._step(words, gold, flat, bounds, (sum_w, sum_t, sum_f), rate)
        return self

    def _step(self, words, gold, flat, bounds, sums, rate) -> None:
        n, there = len(self.labels), words >= 0
        used, index = np.unique(words[there], return_inverse=True)
        sizes = bounds[used + 1] - bounds[used]
        own = np.repeat(np.arange(len(used)), sizes)
        feats = flat[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[used], sizes)]
        scores = np.stack([np.bincount(own, self.w[feats, k], len(used)) for k in range(n)], axis=1)
        e = np.ones((*words.shape, n))
        s = scores[index]
        e[there] = np.exp(s - s.max(axis=1, keepdims=True))
        first, trans = np.exp(self.first), np.exp(self.trans)
        steps = words.shape[1]
        a, b = np.zeros_like(e), np.ones_like(e)
        scale = np.ones(words.shape)
        for t in range(steps):
            x = (first if t == 0 else a[:, t - 1] @ trans) * e[:, t]
            scale[:, t] = x.sum(1)
            a[:, t] = np.where(there[:, t, None], x / scale[:, t, None], a[:, t - 1] if t else x)
        for t in range(steps - 2, -1, -1):
            x = (e[:, t + 1] * b[:, t + 1]) @ trans.T / scale[:, t + 1, None]
            b[:, t] = np.where(there[:, t + 1, None], x, 1.0)
        post = a * b
        post /= post.sum(2, keepdims=True)
        right = np.zeros_like(e)
        right[there, gold[there]] = 1
        diff = (right - post)[there]
        by_word = np.stack([np.bincount(index, diff[:, k], len(used)) for k in range(n)], axis=1)
        both = there[:, 1:]
        pair = a[:, :-1, :, None] * trans * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        pair = pair[both] / pair[both].sum((1, 2), keepdims=True)
        seen = np.zeros((n, n))
        np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        count = max(1, int(there.sum()))
        grad_w = np.stack([np.bincount(feats, by_word[own, k], FEATURES) for k in range(n)], axis=1) / count
        grad_t, grad_f = (seen - pair.sum(0)) / count, (right[:, 0] - post[:, 0])[there[:, 0]].sum(0) / count
        sum_w, sum_t, sum_f = sums
        for weights, grad, total in ((self.w, grad_w, sum_w), (self.trans, grad_t, sum_t), (self.first, grad_f, sum_f)):
            total += grad**2
            weights += rate * grad / np.sqrt(total)

    # -- prediction

    def _rows(self, words: list[str]) -> np.ndarray:
        """Rows of the table of label scores."""
        rows = list(map(self.memo.get, words))
        if None in rows:
            new = list({w for w, r in zip(words, rows, strict=True) if r is None})
            if len(self.memo) + len(new) > MEMO_WORDS:
                self._forget()
                new = list(set(words))
            size = len(self.memo)
            if size + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((size + len(new), len(self.labels)), np.float32)])
            for at in range(0, len(new), 50_000):
                flat, bounds = features(new[at : at + 50_000], self.lexicon)
                sums = np.add.reduceat(self.w[flat], bounds[:-1], axis=0)
                self.table[size + at : size + at + len(sums)] = np.exp(sums - sums.max(axis=1, keepdims=True))
            self.memo.update(zip(new, range(size, size + len(new)), strict=True))
            rows = map(self.memo.__getitem__, words)
        return np.fromiter(rows, np.int64, len(words))

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words of texts, end to end, and the texts' bounds. No text may be empty."""
        sizes = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        rows = self._rows([w for t in texts for w in t])
        e = self.table[rows]
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(texts), np.int64)
        rank[order] = np.arange(len(texts))
        active = len(texts) - np.searchsorted(np.sort(sizes), np.arange(sizes.max()), side="right")
        offset = np.concatenate([[0], np.cumsum(active)])
        step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
        place = offset[step] + np.repeat(rank, sizes)
        e = e + np.float32(1e-6)
        packed = np.empty_like(e)
        packed[place] = e
        first, trans = np.exp(self.first - self.first.max()).astype(np.float32), np.exp(self.trans - self.trans.max()).astype(np.float32)
        a = np.empty_like(packed)
        back = trans.T.copy()
        spots = list(zip(offset[:-1].tolist(), active.tolist(), strict=True))
        x = None
        for at, n in spots:
            x = (first if x is None else x[:n] @ trans) * packed[at : at + n]
            x /= x.sum(1, keepdims=True)
            a[at : at + n] = x
        y, before = None, 0
        for at, n in reversed(spots):
            now = np.ones((n, len(self.labels)), np.float32)
            if y is not None:
                now[:before] = y @ back
                now[:before] /= now[:before].sum(1, keepdims=True)
            a[at : at + n] *= now
            y, before = now * packed[at : at + n], n
        a /= a.sum(1, keepdims=True)
        return a[place], bounds

    def label(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Label and score of each text, and how certain its words' own labels are on average."""
        split = [words_of(t) for t in texts]
        solid = [i for i, ws in enumerate(split) if any(c.isalpha() for w in ws for c in w)]
        labels, scores, sure = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if solid and self.labels:
            p, bounds = self.marginals([split[i] for i in solid])
            sizes = np.diff(bounds)
            shares = np.add.reduceat(p.astype(np.float64), bounds[:-1], axis=0) / sizes[:, None]
            clear = np.add.reduceat(p.max(axis=1).astype(np.float64), bounds[:-1]) / sizes
            for i, k, s, c in zip(solid, shares.argmax(1).tolist(), shares.max(1).tolist(), clear.tolist(), strict=True):
                labels[i], scores[i], sure[i] = self.labels[k], min(1.0, s), min(1.0, c)
        return labels, scores, sure


def held_out(doc_id) -> object:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_label: int = PER_LABEL) -> Crf:
    """Learn from a bounded sample of labelled rows that aren't held out (rows with a null doc_id are)."""
    rows = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Crf([], set())
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 20, (per_label << 20) // n + 1))]), F.col("lang"))
    size, place = F.length("text"), F.xxhash64("doc_id", F.lit("stretch"))
    stretch = F.when(size > MOST_CHARS, F.substring("text", (F.pmod(place, F.greatest(size - MOST_CHARS, F.lit(1))) + 1).cast("int"), F.lit(MOST_CHARS))).otherwise(F.col("text"))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < share).select("doc_id", "lang", stretch.alias("text"))
    sample = sorted(chosen.limit(2 * per_label * len(counts)).collect())
    labels = sorted({r.lang for r in sample})
    seen = Counter(w for r in sample for w in words_of(r.text))
    model = Crf(labels, {w for w, n in seen.items() if n >= LEXICON})
    return model.fit([(r.text, labels.index(r.lang)) for r in sample])


def labelled(docs: DataFrame, model: Crf, keep: list[str] | None = None, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """docs (or its columns ``keep``) with label, score and, if a third name is given, certainty (columns of these
    names are replaced); one pass, no shuffle."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    at, kept = docs.columns.index("text"), [docs.columns.index(c) for c in keep or docs.columns]
    own = list(zip(names, (StringType(), DoubleType(), DoubleType()), (pa.string(), pa.float64(), pa.float64()), strict=False))
    out = StructType([*(docs.schema.fields[i] for i in kept), *(StructField(n, t) for n, t, _ in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        with no_cycles():
            for batch in batches:
                column = batch.column(at)
                # texts of like length together: a step of the chain then serves many of them
                sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
                order = np.argsort(sizes, kind="stable")
                found = (np.empty(len(order), object), np.empty(len(order)), np.empty(len(order)))
                size = np.cumsum(sizes[order].astype(np.int64))
                a = 0
                while a < len(order):
                    b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + AT_ONCE, side="right")))
                    mine = order[a:b]
                    for whole, part in zip(found, crf.label([t or "" for t in column.take(pa.array(mine)).to_pylist()]), strict=True):
                        whole[mine] = part
                    a = b
                columns = [batch.column(i) for i in kept] + [pa.array(f, t) for f, (_, _, t) in zip(found, own, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*(batch.schema.field(i) for i in kept), *((n, t) for n, _, t in own)]))
            crf._forget()  # the worker lives on, and with it every model it has seen

    return docs.mapInArrow(tidy(run), out)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = labelled(only, train(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, least: float = 0.4, clear: float = 0.9) -> DataFrame:
    """The rows of docs whose text is in a language: one label has at least the share ``least`` of the words, or the
    words (of a text in several languages) are labelled with the certainty ``clear`` on average."""
    names = tuple(unused(docs, n) for n in ("label", "share", "certainty"))
    label, share, sure = map(F.col, names)
    return labelled(docs, train(docs), names=names).where((label != UNKNOWN) & ((share >= least) | (sure >= clear))).select(*docs.columns)
