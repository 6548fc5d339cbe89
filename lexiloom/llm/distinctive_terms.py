"""Problem 7: how distinctive a term is for a record.

Method: residual inverse document frequency.  The observed inverse document
frequency of a term less the one expected of a Poisson process of the same
collection frequency is large for terms that are concentrated in few records;
multiplied by the term's frequency in the record it scores the record's terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A record stands for so many tokens when shares are turned into counts: a share below one in
#: so many, a twentieth of the least that ``typical_terms`` is asked for here, is no presence.
RECORD_TOKENS = 10_000


def residual_idf(rows: DataFrame, collection: str, record: str, term: str, weight: str, sizes: DataFrame, record_tokens: int = RECORD_TOKENS) -> DataFrame:
    """Scores of every term of every record of every collection.

    ``rows`` holds a term's share of a record (collection, record, term, weight);
    ``sizes`` the number of records of each collection (collection, n_records).
    Returns ``collection, record, term, weight, total, records, n_records, ridf, score``:
    ``total`` is the sum of the term's weight over the collection's records,
    ``records`` the number of records with at least one expected token of it,
    ``ridf = log2(n_records / records) + log2(1 - exp(-total * record_tokens /
    n_records))`` and ``score = ridf * weight * record_tokens``.

    Rows with a null among the keys or a null, NaN, zero or negative weight are ignored; a row
    delivered several times counts once, with its highest weight; missing rows
    count 0.  A term that reaches one token nowhere counts as held by one record.
    A collection without size has null scores.  Other columns are not read.  An
    empty table gives no rows.
    """
    valid = rows.select(collection, record, term, weight).filter(F.col(weight).isNotNull() & ~F.isnan(weight) & (F.col(weight) > 0) & F.col(collection).isNotNull() & F.col(record).isNotNull() & F.col(term).isNotNull())
    once = valid.groupBy(collection, record, term).agg(F.max(weight).alias(weight))
    over = Window.partitionBy(collection, term)
    held = once.withColumns({"total": F.sum(weight).over(over), "records": F.greatest(F.lit(1), F.sum(F.when(F.col(weight) * record_tokens >= 1, 1).otherwise(0)).over(over))})
    joined = held.join(sizes.select(collection, "n_records"), collection, "left")
    ridf = F.log2(F.col("n_records") / F.col("records")) + F.log2(1 - F.exp(-F.col("total") * record_tokens / F.col("n_records")))
    return joined.withColumn("ridf", ridf).withColumn("score", F.col("ridf") * F.col(weight) * record_tokens)


def typical_terms(scored: DataFrame, weight: str, least: float, share: float, record_tokens: int = RECORD_TOKENS) -> DataFrame:
    """Rows of :func:`residual_idf` whose weight is at least ``least`` and at least ``share`` of the term's total.

    The score selects the candidates.  Let a term's expected tokens be m = total * record_tokens, and one
    record hold the given share of them.  The others hold (1 - share) m at most, and every
    one that counts as a record of the term holds a token, so ``records`` is at most
    1 + (1 - share) m, and never above ``n_records``.  As ``ridf`` falls with ``records``, no such row scores
    less than log2(n_records / that bound) + log2(1 - exp(-m / n_records)) gives: terms that are
    spread over more records fall out, and no row that is asked for does.  The two thresholds are then
    checked on what is left; a row without a score, of a collection without size, is checked as well.
    """
    m = F.col("total") * record_tokens
    most = F.least(F.col("n_records").cast("double"), 1 + (1 - share) * m)
    bound = F.log2(F.col("n_records") / most) + F.log2(1 - F.exp(-m / F.col("n_records")))
    slack = 1e-9 * (1 + F.abs(bound)) * F.col(weight) * record_tokens
    candidates = scored.filter(F.col("score").isNull() | (F.col("score") >= bound * F.col(weight) * record_tokens - slack))
    return candidates.filter((F.col(weight) >= least) & (F.col(weight) >= share * F.col("total")))
