"""Problem 1: frequency of every distinct term or n-gram.

Method: suffix arrays with common-prefix intervals.  Records are brought
together in blocks; every block sorts the suffixes of its token stream, as far as
they go, with the whole common prefix of each two neighbours, and
reads the occurrences of a k-gram, for any k, off the interval of neighbours whose common
prefix is at least k.  The number of records is the interval's size less the
adjacencies, in the suffix order of one record, that share k tokens or more.
Both numbers add up over blocks, so blocks are merged by one aggregation with
map-side combining.

Skew: a record is cut into chunks of ``CHUNK`` positions, so no record, however
large, meets in one task.  A frequent token only ever costs one partial row per
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import materialise

#: Positions of one record that are handled together.
CHUNK = 1 << 16
#: So many records that are cut into chunks are known by broadcast; more are joined.
FEW_RECORDS = 500_000
#: Rows of a block, and so of one suffix array.
BLOCK_ROWS = 1 << 19

_PARTIAL = pa.schema([("n", pa.int32()), ("term", pa.string()), ("record", pa.int64()), ("occurrences", pa.int64()), ("records", pa.int64())])


def suffix_order(codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, by prefix doubling, and the ranks of their first 1, 2, 4, ... tokens.

    ``end[i]`` is the index after the last token that position i can be
    continued to.  A suffix that ends early sorts before its continuations.  Doubling ends
    when all suffixes differ or none goes on.
    """
    size = len(codes)
    here = np.arange(size)
    order = np.argsort(codes, kind="stable")
    rank = codes.astype(np.int64)
    ranks = [rank.astype(np.int32)]
    done, longest = 1, int((end - here).max(initial=0))
    while done < longest:
        follow = np.zeros(size, np.int64)
        reach = here + done
        inside = reach < end
        follow[inside] = rank[reach[inside]] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(size, np.int64)
        fresh[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        rank, done = fresh, done * 2
        ranks.append(rank.astype(np.int32))
        if rank[order[-1]] == size - 1:
            break
    return order, ranks


def common_prefix(ranks: list[np.ndarray], end: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the whole common prefix of suffix pairs, from the longest power of two down."""
    length = np.zeros(len(left), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = left + length, right + length
        at = np.flatnonzero((a + (1 << k) <= end[left]) & (b + (1 << k) <= end[right]))
        at = at[ranks[k][a[at]] == ranks[k][b[at]]]
        length[at] += 1 << k
    return length


def block_intervals(codes: np.ndarray, record: np.ndarray, position: np.ndarray, max_n: int, owned: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: a first suffix, the occurrences and the records of every n-gram of a block.

    Only suffixes that are ``owned`` count as occurrences.
    """
    size = len(codes)
    if not size:
        return
    here = np.arange(size)
    broken = np.r_[(record[1:] != record[:-1]) | (position[1:] != position[:-1] + 1), True]
    end = (np.flatnonzero(broken) + 1)[np.cumsum(np.r_[False, broken[:-1]])]
    order, ranks = suffix_order(codes, end)
    lcp = np.r_[0, common_prefix(ranks, end, order[:-1], order[1:])]
    # the same suffixes, record by record, each record's in suffix order
    within = order[np.argsort(record[order], kind="stable")]
    twin = record[within[1:]] == record[within[:-1]]
    own = common_prefix(ranks, end, within[:-1][twin], within[1:][twin])
    later = within[1:][twin]
    for n in range(1, max_n + 1):
        long_enough = end[order] - order >= n
        members, starts = order[long_enough], (lcp < n)[long_enough]
        if not len(members):
            continue
        interval = np.cumsum(starts) - 1
        where = np.zeros(size, np.int64)
        where[members] = interval
        again = np.bincount(where[later[own >= n]], minlength=interval[-1] + 1)
        count = np.bincount(interval, None if owned is None else owned[members]).astype(np.int64)
        kept = count > 0
        yield n, members[starts][kept], count[kept], (count - again)[kept]


def _terms(dictionary: pa.Array, codes: np.ndarray, first: np.ndarray, n: int) -> pa.Array:
    parts = [dictionary.take(pa.array(codes[first + k])) for k in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")


def _block_rows(table: pa.Table, max_n: int) -> Iterator[pa.RecordBatch]:
    record = table["record"].to_numpy()
    chunk = table["chunk"].to_numpy()
    position = table["pos"].to_numpy().astype(np.int64)
    coded = table["token"].combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    dictionary, codes = coded.dictionary, coded.indices.to_numpy()
    spread = table["spread"].to_numpy()
    context = position // CHUNK != chunk
    for part in (False, True):
        pick = spread == part
        if not pick.any():
            continue
        c, r, p, extra = codes[pick], record[pick], position[pick], context[pick]
        if not part:
            for n, first, tf, df in block_intervals(c, r, p, max_n):
                yield pa.record_batch([pa.array(np.full(len(first), n, np.int32)), _terms(dictionary, c, first, n), pa.nulls(len(first), pa.int64()), pa.array(tf), pa.array(df)], schema=_PARTIAL)
            continue
        # a record that is spread over chunks is counted by name and merged later
        cuts = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (chunk[pick][1:] != chunk[pick][:-1]), True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            for n, first, tf, _ in block_intervals(c[a:b], r[a:b], p[a:b], max_n, ~extra[a:b]):
                yield pa.record_batch([pa.array(np.full(len(first), n, np.int32)), _terms(dictionary, c[a:b], first, n), pa.array(np.full(len(first), r[a])), pa.array(tf), pa.array(np.zeros(len(first), np.int64))], schema=_PARTIAL)


def _count_blocks(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            record, chunk, position = (batch[k].to_numpy() for k in ("record", "chunk", "pos"))
            fresh = np.r_[True, (record[1:] != record[:-1]) | (position[1:] != position[:-1]) | (chunk[1:] != chunk[:-1])]
            if last == (record[0], chunk[0], position[0]):
                fresh[0] = False
            last = (record[-1], chunk[-1], position[-1])
            if not fresh.all():
                batch = batch.filter(pa.array(fresh))
                record, chunk = batch["record"].to_numpy(), batch["chunk"].to_numpy()
            if not batch.num_rows:
                continue
            if rows >= BLOCK_ROWS:
                turns = np.flatnonzero((record[1:] != record[:-1]) | (chunk[1:] != chunk[:-1])) + 1
                before = held[-1]
                if (before["record"][-1].as_py(), before["chunk"][-1].as_py()) != (record[0], chunk[0]):
                    turns = np.r_[0, turns]
                if len(turns):
                    cut = int(turns[0])
                    held.append(batch.slice(0, cut))
                    yield from _block_rows(pa.Table.from_batches(held), max_n)
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield from _block_rows(pa.Table.from_batches(held), max_n)

    return run


def ngram_frequency(tokens: DataFrame, max_n: int = 1, record_col: str = "doc_id", pos_col: str = "pos", token_col: str = "token") -> DataFrame:
    """Occurrences and records of every n-gram of up to ``max_n`` tokens.

    Returns ``n INT, term STRING, occurrences LONG, records LONG``; the tokens of
    an n-gram are joined by a space and stand at consecutive positions.

    Rows without record, position or token, and empty tokens, are ignored and
    break n-grams.  A (record, position) that occurs several times counts once,
    with the smallest of its tokens.  Other columns are not read.  An empty table
    gives no rows.
    """
    rows = tokens.select(F.col(record_col).cast("long").alias("record"), F.col(pos_col).cast("int").alias("pos"), F.col(token_col).alias("token")).filter("record IS NOT NULL AND pos IS NOT NULL AND token <> ''")
    chunk = F.floor(F.col("pos") / F.lit(CHUNK)).cast("int")
    beyond = rows.filter((F.col("pos") >= CHUNK) | (F.col("pos") < 0))
    whole = beyond.isEmpty()
    if whole:
        rows = rows.withColumns({"chunk": F.lit(0), "spread": F.lit(False)})
    else:
        spread = materialise(beyond.select("record").distinct().withColumn("spread", F.lit(True)), "spread")
        if spread.count() <= FEW_RECORDS:
            spread = F.broadcast(spread)
        rows = rows.join(spread, "record", "left").withColumns({"chunk": chunk, "spread": F.coalesce("spread", F.lit(False))})
        if max_n > 1:
            # the first positions of a chunk also follow the last of the one before
            near = F.pmod("pos", F.lit(CHUNK)) < max_n - 1
            rows = rows.withColumn("chunk", F.explode(F.when(near & F.col("spread"), F.array("chunk", F.col("chunk") - 1)).otherwise(F.array("chunk"))))
    blocks = rows.repartition("record", "chunk").sortWithinPartitions("record", "chunk", "pos", "token")
    partial = blocks.mapInArrow(_count_blocks(max_n), "n int, term string, record long, occurrences long, records long")
    if not whole:
        named = partial.groupBy("n", "term", "record").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        return named.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), (F.sum("records") + F.count("record")).alias("records"))
    return partial.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(frequency: DataFrame, records: DataFrame, min_occurrences: int = 10, min_records: int = 5, max_share_percent: int = 90) -> DataFrame:
    """Adds ``mark``: ``common``, ``rare`` or null.

    ``records`` holds one row per record; all of them count, those without terms
    included.  ``common``: in more than ``max_share_percent`` % of the records.
    ``rare``: otherwise, with fewer than ``min_occurrences`` occurrences or in fewer
    than ``min_records`` records.
    """
    total = records.agg(F.count(F.lit(1)).alias("n_records")).scalar()
    return frequency.withColumn("mark", F.when(F.col("records") * 100 > total * max_share_percent, "common").when((F.col("occurrences") < min_occurrences) | (F.col("records") < min_records), "rare"))
