"""Problem 6: the language of every document and paragraph.

Method: multinomial naive Bayes over hashed character n-grams.  The matrix of log
probabilities (buckets x languages, a fixed size) is broadcast; batches of
paragraphs are scored in numpy by gathering the rows of their n-grams and adding
them up by word.  A paragraph's languages compete by words: a single word, however
telling, adds at most ``WORD_LIMIT``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.equal_looking import CYRILLIC, CYRILLIC_LATIN, GREEK, GREEK_LATIN

#: Buckets that n-grams are hashed to.
BUCKETS = 1 << 18
#: Lengths of the n-grams; a word is framed by one space on either side.
LENGTHS = (1, 2, 3, 4, 5)
#: Added to every count.
SMOOTHING = 0.05
#: Most that one word can tell against a language.
WORD_LIMIT = 4.0
#: At most so many labelled rows are fitted; a larger table is sampled by hash.
MAX_SAMPLES = 20_000
#: Labelled documents that a model is refined with, and the confidence from which a label is believed.
MAX_DOCUMENTS = 2_000
AGREEMENT = 0.99
#: Code points that are scored at a time.
WINDOW = 1 << 18

# Names of the languages in labels.
LANGUAGE_NAMES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "nl": ("nld", "dut", "dutch"),
    "ru": ("rus", "russian"),
}


def label_language(label: Column) -> Column:
    """The language that a label names, or null: codes and English names, any case, with or without a region."""
    word = F.lower(F.regexp_extract(label, r"^\s*([A-Za-z]+)\s*(?:[-_].*)?$", 1))
    codes = F.create_map(*(F.lit(x) for code, names in LANGUAGE_NAMES.items() for name in (code, *names) for x in (name, code)))
    return codes[word]


def paragraphs(text: str) -> list[str]:
    """The paragraphs that are not blank, in their order."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if (line[:-1] if line.endswith("\r") else line).strip(" \t"):
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return ["\n".join(x) for x in out if x]


@lru_cache(1)
def _plain() -> dict[int, int | None]:
    """Look-alikes to Latin letters; marks and invisible characters vanish."""
    table: dict[int, int | None] = {ord(a): ord(b) for a, b in zip(CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN)}
    return table | {c: None for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) in ("Cf", "Mn")}


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def plain_text(text: str) -> str:
    """Lower case, compatibility forms mapped, accents and disguises taken off."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_plain())
    return text.lower()


def word_grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n the buckets of the n-grams and the word each belongs to, in order; and the text each word belongs to."""
    plain = [plain_text(x) for x in texts]
    codes = np.frombuffer(" ".join(["", *plain, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(plain)), [len(x) + 1 for x in plain])
    owner = np.r_[owner, len(plain) - 1] if len(plain) else owner
    letter = _letters()[codes]
    keep = letter | np.r_[True, letter[:-1]]
    codes, letter, owner = np.where(letter, codes, 32)[keep], letter[keep], owner[keep]
    opens = letter & ~np.r_[False, letter[:-1]]
    word = np.cumsum(opens) - 1
    parts = []
    size = len(codes)
    for n in LENGTHS:
        if size < n:
            continue
        h = np.full(size - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : size - n + 1 + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        good = letter[: size - n + 1] if n == 1 else np.ones(size - n + 1, bool)
        for k in range(1, n - 1):
            good = good & letter[k : size - n + 1 + k]
        if n == 2:
            good = letter[:-1] | letter[1:]
        at = np.flatnonzero(good)
        # an n-gram that begins with the space before a word belongs to that word
        parts.append(((h[good] >> np.uint64(46)).astype(np.int64), np.where(letter[at], word[at], word[np.minimum(at + 1, size - 1)])))
    return parts, owner[opens]


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of the buckets by language."""

    languages: tuple[str, ...]
    log_prob: np.ndarray

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log posteriors of every word, limited from below, and the text each belongs to."""
        parts, owner = word_grams(texts)
        score = np.zeros((len(owner), len(self.languages)))
        for bucket, word in parts:
            if len(bucket):
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                score[word[starts]] += np.add.reduceat(self.log_prob[bucket], starts)
        top = score.max(axis=1, keepdims=True, initial=-np.inf)
        score = score - top
        score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
        return np.maximum(score, -WORD_LIMIT), owner

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its confidence and the number of words of every text, and the votes by language."""
        score, owner = self.words(texts)
        votes = np.stack([np.bincount(owner, score[:, k], len(texts)) for k in range(len(self.languages))], axis=1)
        n_words = np.bincount(owner, minlength=len(texts))
        best = votes.argmax(axis=1)
        rest = np.exp(votes - votes.max(axis=1, keepdims=True))
        return best, 1 / rest.sum(axis=1), n_words, votes


def _samples(samples: DataFrame, max_samples: int) -> list[tuple[str, str]]:
    labelled = samples.select(label_language(F.col("lang")).alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    return [(r["lang"], r["text"]) for r in labelled.orderBy(F.xxhash64("text"), "text").limit(max_samples).collect()]


def _fitted(rows: list[tuple[str, str]]) -> LanguageModel:
    languages = tuple(sorted({lang for lang, _ in rows}))
    if not languages:
        raise ValueError("no labelled samples")
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    for k, lang in enumerate(languages):
        for bucket, _ in word_grams([text for name, text in rows if name == lang])[0]:
            counts[:, k] += np.bincount(bucket, minlength=BUCKETS)
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def train_language_model(samples: DataFrame, max_samples: int = MAX_SAMPLES) -> LanguageModel:
    """Fit on labelled rows (``lang``, ``text``), at most ``max_samples`` of them, chosen by hash."""
    return _fitted(_samples(samples, max_samples))


def refine_language_model(model: LanguageModel, samples: DataFrame, documents: DataFrame, max_samples: int = MAX_SAMPLES, max_documents: int = MAX_DOCUMENTS) -> LanguageModel:
    """Fit again on the samples and on labelled documents whose paragraphs the model agrees with.

    ``max_documents`` labelled documents are chosen by hash, so wrong labels and
    mixed texts are there; a paragraph is learnt from if the model finds the
    label's language with a confidence of at least ``AGREEMENT``.
    """
    labelled = documents.select(label_language(F.col("lang")).alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = labelled.orderBy(F.xxhash64("text"), "text").limit(max_documents).collect()
    parts = [(r["lang"], x) for r in rows for x in paragraphs(r["text"])]
    agreed: dict[str, list[str]] = {}
    for at in range(0, len(parts), 500):
        best, confidence, _, _ = model.classify([x for _, x in parts[at : at + 500]])
        for (lang, text), k, sure in zip(parts[at : at + 500], best, confidence):
            if sure >= AGREEMENT and model.languages[k] == lang:
                agreed.setdefault(lang, []).append(text)
    return _fitted(_samples(samples, max_samples) + [(lang, x) for lang, texts in agreed.items() for x in texts])


def _pieces(text: str) -> list[str]:
    return [text[i : i + WINDOW] for i in range(0, len(text), WINDOW)] or [""]


def paragraph_languages(documents: DataFrame, model: LanguageModel, label: str | None = None) -> DataFrame:
    """``doc_id LONG, seg_no INT, lang STRING, confidence DOUBLE, words LONG`` of every paragraph.

    Paragraphs are separated by blank lines and count from 0.  ``lang`` is the
    language of most of the words; a paragraph without letters has a null one and
    confidence 0.  Null texts and texts without paragraphs have no rows, repeated
    rows stay repeated, other columns are not read.  ``label``, a string column, is
    passed on if it is named.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        names = np.array([*known.languages], dtype=object)
        for batch in batches:
            rows, numbers, texts = [], [], []
            for row, text in enumerate(batch["text"]):
                for k, part in enumerate(paragraphs(text)):
                    rows.append(row)
                    numbers.append(k)
                    texts.append(part)
            at = 0
            while at < len(texts):
                # paragraphs of one window, and the pieces of a longer one
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= WINDOW):
                    held += len(texts[end])
                    end += 1
                if end == at + 1 and held > WINDOW:
                    parts = [known.classify([piece]) for piece in _pieces(texts[at])]
                    votes = np.sum([x[3] for x in parts], axis=0)
                    n_words = np.sum([x[2] for x in parts], axis=0)
                    best, confidence = votes.argmax(axis=1), 1 / np.exp(votes - votes.max(axis=1, keepdims=True)).sum(axis=1)
                else:
                    best, confidence, n_words, _ = known.classify(texts[at:end])
                none = n_words == 0
                carried = batch.drop(columns="text").iloc[rows[at:end]].reset_index(drop=True)
                yield carried.assign(**{"seg_no": np.array(numbers[at:end], np.int32), "lang": np.where(none, None, names[best]), "confidence": np.where(none, 0.0, confidence), "words": n_words})
                at = end

    carried = [F.col(label).alias("label")] if label else []
    source = documents.select(F.col("doc_id").cast("long"), *carried, "text").filter("text IS NOT NULL")
    return source.mapInPandas(run, f"doc_id long, {'label string, ' if label else ''}seg_no int, lang string, confidence double, words long")


def document_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang, confidence, languages``: the language of most words of each document.

    ``confidence`` is that language's share of the words, weighted by the paragraphs'
    confidence; ``languages`` counts the languages of the paragraphs.
    """
    parts = paragraph_languages(documents, model).filter("lang IS NOT NULL")
    by_lang = parts.groupBy("doc_id", "lang").agg(F.sum("words").alias("words"), F.sum(F.col("words") * F.col("confidence")).alias("sure"))
    best = F.max_by(F.struct("lang", "sure"), F.struct("words", "lang"))
    return by_lang.groupBy("doc_id").agg(best.alias("best"), F.sum("words").alias("words"), F.count(F.lit(1)).cast("int").alias("languages")).select("doc_id", F.col("best.lang").alias("lang"), (F.col("best.sure") / F.col("words")).alias("confidence"), "languages")


def mislabelled_paragraphs(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, seg_no, lang, confidence`` of paragraphs in another language than the document's label names."""
    labelled = documents.select("doc_id", "text", label_language(F.col("lang")).alias("named"))
    found = paragraph_languages(labelled, model, "named")
    return found.filter("lang IS NOT NULL AND NOT (label <=> lang)").select("doc_id", "seg_no", "lang", "confidence")
