"""Problem 3: records that differ only in formatting.

Method: the code points of a text pass through a skip-and-fold lookup table into
polynomial hashes; no canonical string is made.  White space and ASCII
punctuation are skipped and leave one word boundary, letters are folded to one
case.  Header fields are hashed one by one, each together with its name, and
added, so their order does not matter.  Texts with equal hashes are verified by a
two-pointer comparison that skips and folds as it goes.

Skew: only hashes are grouped.  The texts of a group are compared with its first
record, in as many salted parts as the group's size asks for.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import materialise

#: Names of header fields.
HEADER_FIELDS = ("title", "run", "topics", "alpha", "beta", "cycles")
#: Moduli and bases of the two polynomial hashes.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
#: Code points that are hashed or compared at a time.
WINDOW = 1 << 20
#: Members of a group that are compared in one salted part.
PART_ROWS = 20_000

_BLANK = string.whitespace + string.punctuation
_BOUNDARY = 1


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Folded value of every code point; 0 is skipped.  Letters have one case, all else stands for itself."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1F000):
        x = chr(c)
        up = x.upper()
        low = up.lower() if len(up) == 1 else x.lower()
        if len(low) == 1:
            table[c] = ord(low)
    table[[ord(x) for x in _BLANK]] = 0
    table[0] = 0
    return table


@lru_cache(1)
def word_table() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(8)
def _powers(modulus: int, base: int, size: int) -> np.ndarray:
    """base ** 0 ... base ** (size - 1), size a power of two."""
    out = np.ones(size, np.uint64)
    done, step = 1, base % modulus
    while done < size:
        out[done : 2 * done] = out[:done] * np.uint64(step) % np.uint64(modulus)
        done, step = 2 * done, step * step % modulus
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hash_segments(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of symbols of each segment of ``codes``; segments follow each other and none is empty."""
    folded = fold_table()[codes]
    kept = folded > 0
    first = np.zeros(len(codes), bool)
    first[starts] = True
    opens = kept & np.r_[True, ~kept[:-1]] | kept & first
    place = np.cumsum(kept.astype(np.int64) + opens)  # of the symbol; its boundary stands one before
    before = np.r_[0, place][starts]
    length = np.diff(np.r_[before, place[-1]])
    segment = np.repeat(before, np.diff(np.r_[starts, len(codes)]))
    place = place - segment - 1
    size = 1 << max(4, int(length.max(initial=0)).bit_length())
    result = np.zeros(len(starts), np.uint64)
    for modulus, base in zip(MODULI, BASES):
        power = _powers(modulus, base, size)
        m = np.uint64(modulus)
        value = np.where(kept, folded, 0).astype(np.uint64) * power[np.maximum(place, 0)] % m
        value += np.where(opens, power[np.maximum(place - 1, 0)], np.uint64(0)) * np.uint64(_BOUNDARY)
        result = (result << np.uint64(31)) | np.add.reduceat(value, starts) % m
    return result, length


def hash_text(text: str) -> tuple[int, int]:
    """As :func:`hash_segments` for one text of any length, window by window."""
    total, size, inside = [0, 0], 0, False
    for at in range(0, len(text), WINDOW):
        codes = _codes(text[at : at + WINDOW])
        value, length = hash_segments(codes, np.array([0]))
        parts = [int(value[0]) >> 31, int(value[0]) & 0x7FFFFFFF]
        kept = fold_table()[codes] > 0
        joined = inside and bool(kept[0])  # the word goes on, its boundary was counted before
        for k, (modulus, base) in enumerate(zip(MODULI, BASES)):
            part = parts[k] - (_BOUNDARY if joined else 0)
            shift = pow(base, size - joined, modulus)
            total[k] = (total[k] + part * shift) % modulus
        size += int(length[0]) - joined
        inside = bool(kept[-1])
    return total[0] << 31 | total[1], size


_SKIP = "[" + re.escape(_BLANK.replace("\n", "").replace("\r", "")) + "]"
_NAME = "(?:" + "|".join(HEADER_FIELDS) + ")"
_FIELD = re.compile(rf"(?i)(?:(?<={_SKIP})|(?<=[\r\n])|^)({_NAME})(?={_SKIP}*[:=])", re.ASCII)
# what is skipped before a field may hold line breaks: blank lines neither keep a header from beginning nor end it
_HEADER_LINE = re.compile(rf"(?i)[{re.escape(_BLANK)}]*+{_NAME}(?={_SKIP}*[:=])[^\r\n]*(?:\r\n|\r|\n|$)", re.ASCII)


def split_header(text: str) -> tuple[list[tuple[str, str]], str]:
    """Header fields (name, value) in their order, and the body."""
    end = 0
    while end < len(text) and (line := _HEADER_LINE.match(text, end)):
        end = line.end()
    if not end:
        return [], text
    head = text[:end]
    names = list(_FIELD.finditer(head))
    stops = [m.start() for m in names[1:]] + [len(head)]
    return [(m[1].lower(), head[m.end() : stop]) for m, stop in zip(names, stops)], text[end:]


def _mix(value: int, name: str) -> int:
    x = (value * 0x9E3779B97F4A7C15 + HEADER_FIELDS.index(name) + 1) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 32


def hash_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of symbols, and whether there is a letter or digit, of every text."""
    value = np.zeros(len(texts), np.uint64)
    size = np.zeros(len(texts), np.int64)
    worded = np.zeros(len(texts), bool)
    queue: list[tuple[int, str | None, str]] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if queue:
            codes = _codes("".join(x for _, _, x in queue))
            starts = np.cumsum([0, *(len(x) for _, _, x in queue[:-1])])
            hashed, length = hash_segments(codes, starts)
            words = np.logical_or.reduceat(word_table()[codes], starts)
            for (row, name, _), h, n, w in zip(queue, hashed.tolist(), length.tolist(), words.tolist()):
                add(row, name, h, n, w)
            queue.clear()
            held = 0

    def add(row: int, name: str | None, h: int, n: int, w: bool) -> None:
        value[row] = (int(value[row]) + (_mix(h, name) if name else h * 0xD6E8FEB86659FD93)) & 0xFFFFFFFFFFFFFFFF
        size[row] += n
        worded[row] |= w

    for row, text in enumerate(texts):
        fields, body = split_header(text)
        for name, part in [*fields, (None, body)]:
            if len(part) > WINDOW:
                add(row, name, *hash_text(part), any(word_table()[_codes(part[i : i + WINDOW])].any() for i in range(0, len(part), WINDOW)))
            elif part:
                queue.append((row, name, part))
                held += len(part)
            elif name:
                add(row, name, 0, 0, False)
        if held >= WINDOW:
            settle()
    settle()
    return value, size, worded


def _symbols(text: str, window: int) -> Iterator[np.ndarray]:
    """Folded symbols of a text, without what is skipped, a boundary before each word."""
    inside = False
    for at in range(0, len(text), window):
        folded = fold_table()[_codes(text[at : at + window])]
        kept = folded > 0
        opens = kept & ~np.r_[inside, kept[:-1]]
        inside = bool(kept[-1])
        out = np.repeat(folded[kept], 1 + opens[kept])
        ends = np.cumsum(1 + opens[kept]) - 1
        out[ends[opens[kept]] - 1] = _BOUNDARY
        yield out


def same_symbols(a: str, b: str, window: int = 4096) -> bool:
    """Two-pointer comparison: each side advances by a window when it has been used up."""
    left, right = _symbols(a, window), _symbols(b, window)
    x = y = np.empty(0, np.uint32)
    while True:
        while not len(x) and (nxt := next(left, None)) is not None:
            x = nxt
        while not len(y) and (nxt := next(right, None)) is not None:
            y = nxt
        n = min(len(x), len(y))
        if not n:
            return len(x) == len(y)
        if not np.array_equal(x[:n], y[:n]):
            return False
        x, y = x[n:], y[n:]


def same_record(a: str, b: str) -> bool:
    """Whether two texts differ in formatting at most."""
    if a == b:
        return True
    (fields_a, body_a), (fields_b, body_b) = split_header(a), split_header(b)
    if sorted(n for n, _ in fields_a) != sorted(n for n, _ in fields_b) or not same_symbols(body_a, body_b):
        return False
    rest = list(fields_b)
    for name, value in fields_a:
        twin = next((x for x in rest if x[0] == name and same_symbols(value, x[1])), None)
        if twin is None:
            return False
        rest.remove(twin)
    return True


def text_hashes(documents: DataFrame) -> DataFrame:
    """``doc_id, hash LONG, symbols LONG`` of every text with a letter or digit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value, size, worded = hash_texts(list(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"][worded], "hash": value.astype(np.int64)[worded], "symbols": size[worded]})

    rows = documents.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(run, "doc_id long, hash long, symbols long")


def _verified(documents: DataFrame, hashed: DataFrame) -> DataFrame:
    """Each record of a group of equal hashes but its first, and whether the two are the same."""
    group = ["round", "hash", "symbols"]
    groups = hashed.groupBy(group).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    # members of groups are few bytes each; written, their size is known, and only their texts are moved
    pairs = materialise(hashed.join(groups.withColumn("parts", parts), group).distinct(), "groups")
    texts = documents.select(F.col("doc_id").cast("long"), "text").filter("text IS NOT NULL")
    members = pairs.filter("doc_id <> keep_id").join(texts, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    own = pairs.filter("doc_id = keep_id").select("keep_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    firsts = own.distinct().join(texts.select(F.col("doc_id").alias("keep_id"), F.col("text").alias("keep_text")), "keep_id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [same_record(a, b) for a, b in zip(batch["keep_text"], batch["text"])]
            yield batch.drop(columns=["text", "keep_text"]).assign(same=same)

    rows = members.join(firsts, ["keep_id", "part"]).select(*group, "keep_id", "doc_id", "keep_text", "text")
    return rows.mapInPandas(compare, "round long, hash long, symbols long, keep_id long, doc_id long, same boolean")


def copy_pairs(documents: DataFrame) -> DataFrame:
    """Every copy with the record that is kept for it: ``keep_id, doc_id``.

    Two texts are copies if they hold the same words in the same order, apart
    from letter case (one letter for one letter), ASCII white space, ASCII
    punctuation and the order and separators of header fields.  The record kept is
    the one of the smallest ``doc_id``; it has no row.  Null texts and texts without
    letters or digits are no copies; rows that repeat a ``doc_id`` and text count
    once.  Other columns are not read.  An empty table gives no rows.  Eager: the
    verified pairs are written; unequal texts of one hash go round again.
    """
    hashed = materialise(text_hashes(documents).withColumn("round", F.lit(0).cast("long")), "hashes")
    done: DataFrame | None = None
    while True:
        checked = materialise(_verified(documents, hashed), "copies")
        found = checked.filter("same").select("keep_id", "doc_id").distinct()
        done = found if done is None else done.union(found)
        hashed = checked.filter("NOT same").select(F.col("keep_id").alias("round"), "hash", "symbols", "doc_id")
        if hashed.isEmpty():
            return done


def collapse_copies(documents: DataFrame) -> DataFrame:
    """One row per record that has copies: ``keep_id, n_copies`` (itself included)."""
    return copy_pairs(documents).groupBy("keep_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
