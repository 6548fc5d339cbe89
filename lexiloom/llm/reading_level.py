"""Problem 10: how demanding each document is to read.

Method: interpolated n-gram models of characters, one for each band of graded
samples, give the surprisals of every sentence of a document.  Their contrast, the
mean grade that the bands' likelihoods would give, is mapped by isotonic regression
to one scale from 0 (beginners' pages) over 1 (plain) to 2 (research prose); it is
fitted on sentences that the models were not trained on.  A document's level is the mean
over its sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.format_copies import split_header
from lexiloom.llm.language_id import LanguageModel, paragraphs, plain_text

#: The bands of the graded samples, in order.
BANDS = ("easy", "plain", "hard")
#: Longest context, in characters.
ORDER = 3
#: Buckets of the count tables.
BUCKETS = 1 << 16
#: Bits by which one word, such as an invented name, can tell against a band at most.
WORD_LIMIT = 4.0
#: Weight of a word that no sample holds, such as a name.
STRANGER = 0.2
#: Words that the surprisal of a sentence's length counts for.
LENGTH_WORDS = 2.0
#: Words of a sentence that count as independent evidence.
EVIDENCE = 6.0
#: Bins of sentences that the isotonic map is fitted to, so that no single one sets a knot.
BINS = 30
#: Parts of the samples that are held out in turn.
FOLDS = 6
#: At most so many graded samples are fitted, chosen by hash.
MAX_SAMPLES = 5_000
#: Code points that are scored at a time.
WINDOW = 1 << 18
#: Sentences with fewer letters than this are part of the one before.
LEAST_LETTERS = 6

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("approx", "cf", "e.g", "etc", "fig", "i.e", "no", "vs")

_NOT_AFTER = "".join(rf"(?<!\b{re.escape(x)}\.)" for x in ABBREVIATIONS)
_END = re.compile(rf"(?i)(?<=[.!?]){_NOT_AFTER}[\"')\]]*\s+(?![0-9])|(?:\r?\n[ \t]*){{2,}}")


def sentences(text: str) -> list[str]:
    """Sentences of a text; a piece with hardly any letter belongs to the one before.

    Text without letters has no sentences.
    """
    out: list[str] = []
    for part in _END.split(text):
        # most parts are seen to be long enough from their first few letters
        letters = sum(1 for _ in islice((m for m in _LETTERS.finditer(part) if m[0].isalpha()), LEAST_LETTERS))
        if out and letters < LEAST_LETTERS:
            out[-1] += " " + part
        elif letters:
            out.append(part)
    return out


_LETTERS = re.compile(r"[^\W\d_]")
_NOT_WORD = re.compile(r"[^\w]+|_+")
_DIGITS = re.compile(r"\d+")


def _spelled(text: str) -> str:
    """Letters in one case, numbers as 0, single spaces."""
    return " " + _DIGITS.sub("0", _NOT_WORD.sub(" ", plain_text(text))).strip() + " "


def _hashes(codes: np.ndarray, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets of the contexts and of the contexts with their symbol.

    Spaces stand before a sentence, so what is measured does not depend on its neighbours.
    """
    out = []
    context = np.zeros(len(codes), np.uint64)
    for m in range(ORDER + 1):
        if m:
            back = np.full(len(codes), 32, np.uint64)
            if m < len(codes):
                back[m:] = np.where(owner[m:] == owner[:-m], codes[:-m], 32)
            context = (context + back + np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15)
        with_symbol = (context ^ (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x94D049BB133111EB)
        out.append(((context >> np.uint64(48)).astype(np.int64), (with_symbol >> np.uint64(48)).astype(np.int64)))
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(texts)), [len(x) for x in texts])


@dataclass(frozen=True)
class NgramModels:
    """One character model for each band, with Witten-Bell interpolation.

    Tables are by order and bucket, the bands side by side, so one access serves them all.
    """

    #: Of a context: 1 / (occurrences + kinds of followers), then kinds over the same.
    context: np.ndarray
    #: Occurrences of a context with its symbol.
    counts: np.ndarray
    #: Mean and deviation of the logarithm of a sentence's words, by band.
    length: np.ndarray

    @staticmethod
    def fit(by_band: list[list[str]]) -> NgramModels:
        n = len(by_band)
        context = np.zeros((ORDER + 1, BUCKETS, 2 * n), np.float32)
        context[:, :, n:] = 1.0  # a context never seen leaves all to the shorter one
        counts = np.zeros((ORDER + 1, BUCKETS, n), np.float32)
        length = np.zeros((n, 2))
        for k, texts in enumerate(by_band):
            spelled = [_spelled(x) for x in texts]
            size = np.log([len(x.split()) + 1 for x in spelled])
            length[k] = size.mean(), size.std() + 0.1
            for m, (at, symbol) in enumerate(_hashes(*_codes(spelled))):
                seen = np.bincount(at, minlength=BUCKETS)
                kinds = np.bincount(np.unique(at << 16 | symbol) >> 16, minlength=BUCKETS)
                context[m, seen > 0, k] = 1 / (seen + kinds)[seen > 0]
                context[m, seen > 0, n + k] = (kinds / np.maximum(seen + kinds, 1))[seen > 0]
                counts[m, :, k] = np.bincount(symbol, minlength=BUCKETS)
        return NgramModels(context, counts, length)

    def surprisal(self, codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Bits of every symbol under every model."""
        n = len(self.length)
        p = np.full((len(codes), n), 1 / 256, np.float32)
        for m, (at, symbol) in enumerate(_hashes(codes, owner)):
            known = self.context[m][at]
            p *= known[:, n:]
            p += self.counts[m][symbol] * known[:, :n]
        return -np.log2(np.minimum(p, 1.0))

    def length_bits(self, words: np.ndarray) -> np.ndarray:
        """Bits of sentences having so many words, by model."""
        mean, deviation = self.length.T
        return np.square((np.log(words + 1)[:, None] - mean) / deviation) / (2 * np.log(2)) + np.log2(deviation)


def isotonic_fit(x: np.ndarray, y: np.ndarray, bins: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit: pool adjacent violators, of ``bins`` means if given.  Returns the knots."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for part in np.array_split(order, min(bins or len(x), len(x))):
        at = float(x[part].mean())
        blocks.append([float(y[part].mean()), float(len(part)), at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, weight, _, last = blocks.pop()
            top = blocks[-1]
            top[0] = (top[0] * top[1] + mean * weight) / (top[1] + weight)
            top[1] += weight
            top[3] = last
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in (b[0], b[0])])
    return xs, ys


@dataclass(frozen=True)
class ReadingModel:
    """Models of the bands and the knots of the isotonic map."""

    models: NgramModels
    vocabulary: frozenset[str]
    knots_x: np.ndarray
    knots_y: np.ndarray

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean surprisal of the easy model and the level of every sentence."""
        bits, excess = _surprisals(self.models, self.vocabulary, texts)
        return bits, np.interp(contrast(excess), self.knots_x, self.knots_y)


def contrast(excess: np.ndarray) -> np.ndarray:
    """Mean grade under the likelihoods of the bands' models, from the mean excess bits of the words."""
    weight = np.exp2((excess.min(axis=1, keepdims=True) - excess) * EVIDENCE)
    return (weight / weight.sum(axis=1, keepdims=True)) @ np.arange(excess.shape[1], dtype=float)


def _surprisals(models: NgramModels, vocabulary: frozenset[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each sentence: mean bits of its symbols under the first model; by model, the mean excess bits of its words."""
    spelled = [_spelled(x) for x in texts]
    codes, owner = _codes(spelled)
    ends = codes == 32
    bits = models.surprisal(codes, owner)
    # a word ends with its space, as every sentence does
    by_word = np.add.reduceat(bits, np.flatnonzero(np.r_[True, ends[:-1]])) if len(codes) else bits
    excess = np.minimum(by_word - by_word.min(axis=1, keepdims=True, initial=np.inf), WORD_LIMIT)
    # a sentence is framed by spaces: its words and the empty one before them
    words = np.array("".join(spelled).split(" "), dtype=object)[:-1]
    known = {w: 1.0 if w in vocabulary or not w else STRANGER for w in set(words.tolist())}
    weight = np.fromiter(map(known.__getitem__, words), float, len(words))
    of = owner[ends]
    length = models.length_bits(np.bincount(of, minlength=len(texts)) - 1)
    length = np.minimum(length - length.min(axis=1, keepdims=True), WORD_LIMIT) * LENGTH_WORDS
    n_words = np.bincount(of, weight, len(texts)) + LENGTH_WORDS
    mean = np.stack([(np.bincount(of, excess[:, k] * weight, len(texts)) + length[:, k]) / n_words for k in range(bits.shape[1])], axis=1)
    return np.bincount(owner, bits[:, 0], len(texts)) / np.maximum(np.bincount(owner, minlength=len(texts)), 1), mean


def _vocabulary(rows: list[tuple[str, list[str]]]) -> frozenset[str]:
    return frozenset(w for _, part in rows for s in part for w in _spelled(s).split())


def train_reading_model(samples: DataFrame, max_samples: int = MAX_SAMPLES) -> ReadingModel:
    """Fit on graded rows (``band``, ``text``), at most ``max_samples`` of them, chosen by hash."""
    graded = samples.select("band", "text").filter(F.col("band").isin(*BANDS) & F.col("text").isNotNull())
    rows = [(r["band"], sentences(r["text"])) for r in graded.orderBy(F.xxhash64("text"), "text").limit(max_samples).collect()]
    if {b for b, _ in rows} != set(BANDS):
        raise ValueError("samples of every band are needed")
    fit = lambda part: NgramModels.fit([[s for b, x in part if b == band for s in x] for band in BANDS])
    xs, ys = [], []
    for fold in range(FOLDS):
        rest = [r for k, r in enumerate(rows) if k % FOLDS != fold]
        held = [r for k, r in enumerate(rows) if k % FOLDS == fold]
        known = {x for _, part in rest for x in part}
        pairs = [(BANDS.index(b), s) for b, part in held for s in part if s not in known]
        if pairs and {b for b, _ in rest} == set(BANDS):
            xs.append(contrast(_surprisals(fit(rest), _vocabulary(rest), [s for _, s in pairs])[1]))
            ys.append([float(g) for g, _ in pairs])
    if not xs:
        raise ValueError("too few samples to hold any out")
    knots = isotonic_fit(np.concatenate(xs), np.concatenate(ys), BINS)
    return ReadingModel(fit(rows), _vocabulary(rows), *knots)


def reading_levels(documents: DataFrame, model: ReadingModel, languages: LanguageModel, english_only: bool = False) -> DataFrame:
    """The level of every document.

    Returns ``doc_id LONG, level DOUBLE, sentences INT, easy_share DOUBLE, hard_share DOUBLE,
    surprisal_mean DOUBLE, surprisal_p10 DOUBLE, surprisal_p90 DOUBLE, english BOOLEAN``.

    The header is left out.  ``level`` runs from 0 to 2; ``easy_share`` and
    ``hard_share`` are the sentences nearer to the easy or the hard samples than to
    the plain ones; the surprisal is the easy model's, over the sentences.
    ``english``: every paragraph with letters is; with ``english_only`` other documents are neither measured
    nor returned, and of each only as many paragraphs are told as it takes to find one that is not.  Texts without sentences have no
    row, nor have null texts.  Repeated rows stay repeated, other columns are not
    read.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model, languages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reading, known = shared.value
        for batch in batches:
            docs = list(zip(batch["doc_id"], batch["text"]))
            at = 0
            while at < len(docs):
                end, held = at, 0
                while end < len(docs) and (end == at or held + len(docs[end][1]) <= WINDOW):
                    held += len(docs[end][1])
                    end += 1
                yield _measured(docs[at:end], reading, known, english_only)
                at = end

    schema = "doc_id long, level double, sentences int, easy_share double, hard_share double, surprisal_mean double, surprisal_p10 double, surprisal_p90 double, english boolean"
    rows = documents.select(F.col("doc_id").cast("long"), "text").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    return rows.mapInPandas(run, schema)


def _in_windows(texts: list[str], measure) -> list[tuple]:
    out, at = [], 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= WINDOW):
            held += len(texts[end])
            end += 1
        out.append(measure(texts[at:end]))
        at = end
    return out


def _foreign(texts: list[str], languages: LanguageModel, until_one: bool) -> np.ndarray:
    """Whether a text has a paragraph with letters that is not English.

    ``until_one``: texts whose first paragraph is foreign are not told further.
    """
    blocks = [paragraphs(text) for text in texts]
    foreign = np.zeros(len(texts), bool)
    english = languages.languages.index("en") if "en" in languages.languages else -1
    for turn in (slice(0, 1), slice(1, None)) if until_one else (slice(None),):
        pieces = [(k, x) for k, block in enumerate(blocks) if not foreign[k] for x in block[turn]]
        if pieces:
            told = _in_windows([x for _, x in pieces], languages.classify)
            best, n_words = np.concatenate([m[0] for m in told]), np.concatenate([m[2] for m in told])
            other = (n_words > 0) & (best != english)
            foreign[[k for (k, _), x in zip(pieces, other.tolist()) if x]] = True
    return foreign


_COLUMNS = ["doc_id", "level", "sentences", "easy_share", "hard_share", "surprisal_mean", "surprisal_p10", "surprisal_p90", "english"]


def _measured(docs: list[tuple[int, str]], model: ReadingModel, languages: LanguageModel, english_only: bool) -> pd.DataFrame:
    foreign = _foreign([text for _, text in docs], languages, english_only)
    if english_only:
        docs = [x for x, f in zip(docs, foreign.tolist()) if not f]
        foreign = foreign[~foreign]
    parts = [sentences(split_header(text)[1]) for _, text in docs]
    flat = [s for x in parts for s in x]
    if not flat:
        return pd.DataFrame({c: [] for c in _COLUMNS})
    measured = _in_windows(flat, model.measure)
    bits, level = (np.concatenate([m[k] for m in measured]) for k in (0, 1))
    rows, start = [], 0
    for (doc_id, _), part, f in zip(docs, parts, foreign.tolist()):
        b, g = bits[start : start + len(part)], level[start : start + len(part)]
        start += len(part)
        if len(part):
            p10, p90 = np.quantile(b, [0.1, 0.9])
            rows.append((doc_id, float(g.mean()), len(part), float((g < 0.5).mean()), float((g > 1.5).mean()), float(b.mean()), float(p10), float(p90), not f))
    return pd.DataFrame(rows, columns=_COLUMNS)


def bands(levels: DataFrame, share: float = 0.75) -> DataFrame:
    """``doc_id, band`` of English documents of which at least ``share`` of the sentences are easy, or hard."""
    band = F.when(F.col("easy_share") >= share, "easy").when(F.col("hard_share") >= share, "hard")
    return levels.filter("english").select("doc_id", band.alias("band")).filter("band IS NOT NULL").distinct()
