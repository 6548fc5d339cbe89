"""Problem 5: text that looks the same but is stored with different characters.

Method: DuckDB runs inside Arrow partitions.  One embedded SQL statement maps
compatibility forms and unusual spaces (``translate``), removes invisible
characters and expands ligatures (regular expressions), composes accents
(``nfc_normalize``) and settles look-alike letters word by word.  For that, accents
are taken off the letters that have look-alikes, and composed again at the end.

A word is written in the script of those of its letters that no other script
looks like; a word without such letters takes the script that such letters have
most of in the whole text.  Swapping look-alikes therefore never changes the
result, and Russian or Greek words stay in their own script.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import materialise

# Cyrillic and Greek letters and the Latin letters they are drawn like, in the same order.
CYRILLIC = "АВЕЅІЈКМНОРСТУХасеѕіјорхуһԁԛԝ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXacesijopxyhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧινο"
GREEK_LATIN = "ABEZHIKMNOPTYXivo"


#: Text that one statement works on, and memory that DuckDB may use for it.
SLICE_BYTES = 4 << 20
MEMORY = "400MB"

# Kinds of compatibility forms that are drawn like their plain form; raised, lowered,
# circled, squared or slashed ones are not.
ALIKE = {"<" + kind for kind in ("compat", "final", "font", "initial", "isolated", "medial", "narrow", "noBreak", "small", "wide")}


@lru_cache(1)
def _tables() -> dict[str, str]:
    single_from, single_to, spaces, several, invisible, accented = [], [], [], {}, [], {}
    lookalike = set(CYRILLIC + CYRILLIC_LATIN + GREEK + GREEK_LATIN)
    for c in range(0x80, 0x110000):
        x = chr(c)
        kind = unicodedata.category(x)
        if kind == "Zs":
            spaces.append(x)
        elif kind == "Cf":
            invisible.append(x)
        elif unicodedata.decomposition(x).split(">")[0] in ALIKE:
            # the folded form of a compatibility character; spacing accents stand for themselves
            y = unicodedata.normalize("NFKC", x)
            if y[:1] == " " or y == x:
                continue
            if len(y) == 1:
                single_from.append(x)
                single_to.append(y)
            else:
                several[x] = y
        elif unicodedata.decomposition(x) and (y := unicodedata.normalize("NFD", x))[0] in lookalike and len(y) > 1:
            accented[x] = y
    # fillers, inherent vowels and variation selectors are drawn as nothing, though they are no format characters
    invisible += [chr(c) for c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180E), 0x180F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))]
    return {"from": "".join(single_from + spaces), "to": "".join(single_to + [" "] * len(spaces)), "invisible": "".join(invisible), "several": several, "accented": accented}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _char_class(text: str) -> str:
    """An RE2 class of these characters, neighbours as ranges."""
    codes, parts = sorted(map(ord, text)), []
    for c in codes:
        if parts and parts[-1][1] == c - 1:
            parts[-1][1] = c
        else:
            parts.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in parts) + "]"


def _expanded(table: dict[str, str]) -> str:
    """SQL that replaces every character of ``t`` that the table has by its several ones."""
    kind = _char_class("".join(table))
    pairs = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in table.items()) + "}"
    parts = f"regexp_extract_all(t, '{kind}|[^{kind[1:]}+')"
    return f"CASE WHEN regexp_matches(t, '{kind}') THEN array_to_string(list_transform({parts}, lambda c: CASE WHEN length(c) = 1 THEN coalesce(({pairs})[c], c) ELSE c END), '') ELSE t END"


@lru_cache(1)
def consistent_sql(source: str = "batch") -> str:
    """The embedded statement: ``doc_id, text, original_md5`` of every row of ``source``."""
    t = _tables()
    lookalike = CYRILLIC + GREEK
    latin = "".join(sorted(set(CYRILLIC_LATIN + GREEK_LATIN)))
    to = {"l": f"translate({{0}}, {_quoted(lookalike)}, {_quoted(CYRILLIC_LATIN + GREEK_LATIN)})"}
    to["c"] = f"translate({to['l']}, {_quoted(CYRILLIC_LATIN)}, {_quoted(CYRILLIC)})"
    to["g"] = f"translate({to['l']}, {_quoted(GREEK_LATIN)}, {_quoted(GREEK)})"
    # once a text is in its main script, letters of another one are not look-alikes; only their words are left
    other = {"l": "[\\p{{Cyrillic}}\\p{{Greek}}]", "c": "[\\p{{Latin}}\\p{{Greek}}]", "g": "[\\p{{Latin}}\\p{{Cyrillic}}]"}
    foreign = "CASE main " + " ".join(f"WHEN '{k}' THEN regexp_matches({{0}}, '{v}')" for k, v in other.items()) + " END"
    bare = f"translate(w, {_quoted(lookalike + latin)}, '')"
    word = f"CASE WHEN regexp_matches({bare}, '\\p{{Latin}}') THEN {to['l'].format('w')} WHEN regexp_matches({bare}, '\\p{{Cyrillic}}') THEN {to['c'].format('w')} ELSE {to['g'].format('w')} END"
    words = "regexp_extract_all(t, '[\\p{L}\\p{M}]+|[^\\p{L}\\p{M}]+')"
    settled = f"array_to_string(list_transform({words}, lambda w: CASE WHEN {foreign.format('w')} THEN {word} ELSE w END), '')"
    own = f"translate(t, {_quoted(lookalike + latin)}, '')"
    count = "length(regexp_replace({0}, '[^\\p{{{1}}}]+', '', 'g'))"
    cyr, gre, lat = (count.format("own", s) for s in ("Cyrillic", "Greek", "Latin"))
    return f"""
        WITH plain AS (
            SELECT doc_id, text AS original,
                regexp_replace(CASE WHEN regexp_matches(text, '{_char_class(t["from"])}') THEN translate(text, {_quoted(t["from"])}, {_quoted(t["to"])}) ELSE text END, '{_char_class(t["invisible"])}+', '', 'g') AS t
            FROM {source}
        ), expanded AS (
            SELECT doc_id, original, nfc_normalize({_expanded(t["several"])}) AS t FROM plain
        ), weighed AS (
            SELECT *, regexp_matches(t, '[\\p{{Cyrillic}}\\p{{Greek}}]') AS mixed FROM expanded
        ), bared AS (
            SELECT doc_id, original, mixed, CASE WHEN mixed THEN {_expanded(t["accented"])} ELSE t END AS t FROM weighed
        ), counted AS (
            SELECT *, CASE WHEN mixed THEN {own} END AS own FROM bared
        ), led AS (
            SELECT *, CASE WHEN NOT mixed THEN 'l' WHEN {cyr} > greatest({lat}, {gre}) THEN 'c' WHEN {gre} > greatest({lat}, {cyr}) THEN 'g' ELSE 'l' END AS main FROM counted
        ), moved AS (
            SELECT doc_id, original, mixed, main, CASE WHEN NOT mixed THEN t WHEN main = 'c' THEN {to['c'].format('t')} WHEN main = 'g' THEN {to['g'].format('t')} ELSE {to['l'].format('t')} END AS t FROM led
        )
        SELECT doc_id, CASE WHEN NOT mixed THEN t ELSE nfc_normalize(CASE WHEN {foreign.format('t')} THEN {settled} ELSE t END) END AS text, md5(original) AS original_md5 FROM moved"""


def _connect():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
    con.execute("SET enable_progress_bar = false")
    return con


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold ``SLICE_BYTES`` of text, or one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, SLICE_BYTES + (size[at - 1] if at else 0), side="right")))
        yield batch.slice(at, end - at)
        at = end


def consistent_texts(documents: DataFrame) -> DataFrame:
    """Every document's text in one form: ``doc_id LONG, text STRING, original_md5 STRING``.

    Null texts stay null and empty ones empty.  Letter case, accents, line breaks,
    ordinary spaces and punctuation are kept.  Repeated rows stay repeated, other
    columns are not read, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, sql = _connect(), consistent_sql()
        for whole in batches:
            for batch in _slices(whole):
                con.register("batch", pa.Table.from_batches([batch]))
                result = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from result.cast(pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("original_md5", pa.string())])).to_batches()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, original_md5 string")


def disguised_copies(documents: DataFrame) -> DataFrame:
    """Documents whose texts look alike but are stored differently: ``keep_id, doc_id``.

    One row for each document of a group but the one of the smallest ``doc_id``,
    which is ``keep_id``.  Groups of identical texts, null texts and rows without
    ``doc_id`` are left out.  Eager: two digests of every text are written, so that no text is worked on twice.
    """
    looks = consistent_texts(documents.filter("text IS NOT NULL AND doc_id IS NOT NULL")).select("doc_id", F.sha2("text", 256).alias("look"), "original_md5")
    keys = materialise(looks, "looks")
    groups = keys.groupBy("look").agg(F.min("doc_id").alias("keep_id"), F.min("original_md5").alias("a"), F.max("original_md5").alias("b")).filter("a <> b")
    return keys.join(groups, "look").filter("doc_id <> keep_id").select("keep_id", "doc_id").distinct()
