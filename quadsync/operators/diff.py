"""Set operations on triple DataFrames.

Lexical identity = the N-Triples columns; logical identity swaps ``o`` for
``o_key`` (canonical object text). Both are plain equi-join keys with ''
sentinels instead of nulls, so every comparison is a hash/sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadsync.sources.packed import SHORT_COLS, SubjectChanges, SubjectRows, as_changed, in_short_changed, logical_term, spelled
from quadsync.vocab import LEXICAL_KEY, LOGICAL_KEY, TRIPLE_COLS

OUT_COLS = TRIPLE_COLS + ["o_key"]


def snapshot_diff(expected: DataFrame, current: DataFrame, key: list[str] = LEXICAL_KEY) -> DataFrame:
    """``op='insert'`` for expected\\current, ``'delete'`` for current\\expected.

    One full outer join (one shuffle per side) instead of two anti joins.
    """
    a = expected.select(*OUT_COLS).withColumn("_a", F.lit(True))
    b = current.select(*OUT_COLS).withColumn("_b", F.lit(True))
    other = [c for c in OUT_COLS if c not in key]
    j = a.alias("a").join(b.alias("b"), key, "full_outer")
    picked = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in other]
    return (j.where(F.col("_a").isNull() | F.col("_b").isNull())
            .select(F.when(F.col("_b").isNull(), F.lit("insert")).otherwise(F.lit("delete")).alias("op"),
                    *key, *picked)
            .select("op", *OUT_COLS))


def rows_diff(expected: SubjectRows, current: SubjectRows) -> DataFrame:
    """U1 of two sets of one row per subject, which are moved as such to their subject and spread there."""
    both = expected.df.select("s", "terms", F.lit(1).alias("_in")).unionByName(current.df.select("s", "terms", F.lit(2).alias("_in")))
    one = (both.repartition("s").select("s", "_in", F.inline("terms")).groupBy("s", *SHORT_COLS).agg(F.bit_or("_in").alias("_in")).where(F.col("_in") < 3))
    return one.select(*spelled(["_in", "s"])).select(F.when(F.col("_in") == 1, "insert").otherwise("delete").alias("op"), *OUT_COLS)


def bag_diff(expected: DataFrame, current: DataFrame) -> DataFrame:
    """Bag difference both ways (surplus duplicates are kept): one count of either side's rows."""
    both = (expected.select(*TRIPLE_COLS, F.lit(1).alias("_n"))
            .unionByName(current.select(*TRIPLE_COLS, F.lit(-1).alias("_n"))))
    surplus = both.groupBy(*TRIPLE_COLS).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    return (surplus.select(*TRIPLE_COLS, F.when(F.col("_n") > 0, "insert").otherwise("delete").alias("op"),
                           F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))).drop("col"))


def apply_patch(publication: DataFrame, patch: DataFrame, key: list[str] = LEXICAL_KEY) -> DataFrame:
    """K1/Q19: deletes first, then inserts; result is a set."""
    if isinstance(patch, SubjectChanges):
        return _rows_patched(publication, patch)
    deletes = patch.where(F.col("op") == "delete").select(*key)
    inserts = patch.where(F.col("op") == "insert").select(*OUT_COLS)
    kept = publication.select(*OUT_COLS).join(deletes, key, "left_anti")
    return kept.unionByName(inserts).distinct()


def _logical_set(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct by logical identity; the smallest lexical form represents it."""
    return (df.groupBy(*keys, *LOGICAL_KEY).agg(F.min("o").alias("o"))
            .select(*keys, *OUT_COLS))


def fold_cancel(changes: DataFrame, keys: list[str] = ("msg_id",)) -> DataFrame:
    """Per message, deletes\\inserts and inserts\\deletes (order ignored)."""
    keys = list(keys)
    d = _logical_set(changes.where(F.col("op") == "delete"), keys)
    i = _logical_set(changes.where(F.col("op") == "insert"), keys)
    k = keys + LOGICAL_KEY
    return (d.join(i.select(*k), k, "left_anti").withColumn("op", F.lit("delete"))
            .unionByName(i.join(d.select(*k), k, "left_anti").withColumn("op", F.lit("insert"))))


def fold_last(changes: DataFrame, order: list[str] = ("msg_id", "cs_no", "pos"),
              keys: list[str] = ()) -> DataFrame:
    """Q10 ``fold='last'``: the last change per triple wins (deletes sort
    before inserts at the same position).

    An aggregate (max of an ordering struct), not a window: partial
    aggregation runs map-side, so a triple changed very often does not
    pull all its changes into one task.
    """
    keys = list(keys)
    op_rank = F.when(F.col("op") == "delete", 0).otherwise(1)
    last = F.max(F.struct(*[F.col(c) for c in order], op_rank.alias("_r"), F.col("op"), F.col("o")))
    return (changes.groupBy(*keys, *LOGICAL_KEY).agg(last.alias("_l"))
            .select(*keys, F.col("_l.op").alias("op"), "s", "p", F.col("_l.o").alias("o"),
                    "o_kind", "o_dt", "o_lang", "o_key"))


def effective_changes(folded: DataFrame, publication: DataFrame) -> DataFrame:
    """Deletes that are published, inserts that are not (logical)."""
    if isinstance(folded, SubjectChanges):
        return _rows_effective(folded, publication)
    pub = publication.select(*LOGICAL_KEY)  # asked by semi joins only, which repeats do not change
    d = folded.where(F.col("op") == "delete").join(pub, LOGICAL_KEY, "left_semi")
    i = folded.where(F.col("op") == "insert").join(pub, LOGICAL_KEY, "left_anti")
    return d.unionByName(i)


def _known(terms: str, y):
    """Whether the changed term ``y`` is among ``terms``, logical keys that may be missing; a key with a null equals none.
    (``terms`` is named twice, so that no plan computes it for every ``y``.)"""
    own = y["t"].isNotNull()
    unknown = F.when(own, y["k"].isNull() | y["lang"].isNull()).otherwise(y["other"]["o_key"].isNull() | y["other"]["o_lang"].isNull())
    return F.when(F.col(terms).isNull() | unknown, False).otherwise(F.array_contains(terms, logical_term(y)))


def _rows_effective(changes: SubjectChanges, publication: SubjectRows) -> SubjectChanges:
    """U6 of a row per subject: a subject's changes meet what is published of it in one join."""
    pub = publication.df.select("s", F.col("terms").alias("_pub"))
    x = (changes.df.join(pub, "s", "left")
         .select("s", "op", "terms", F.transform("_pub", lambda y: logical_term(as_changed(y))).alias("_there")))
    real = F.filter("terms", lambda y: _known("_there", y) == (F.col("op") == "delete"))
    return SubjectChanges(x.select("s", "op", real.alias("terms")))


def published_deletes(changes: SubjectChanges, publication: SubjectRows) -> SubjectChanges:
    """The deletes of ``changes`` in the spellings that are published."""
    gone = changes.df.where(F.col("op") == "delete").select("s", F.col("terms").alias("_del"))
    x = (publication.df.join(gone, "s")
         .select("s", F.transform("terms", as_changed).alias("terms"), F.transform("_del", logical_term).alias("_gone")))
    return SubjectChanges(x.select("s", F.lit("delete").alias("op"), F.filter("terms", lambda y: _known("_gone", y)).alias("terms")))


def _rows_patched(publication: SubjectRows, patch: SubjectChanges) -> DataFrame:
    """K1 of a row per subject; the triples of no subject are told apart one by one."""
    side = lambda op, name: patch.df.where(F.col("op") == op).select("s", F.transform("terms", in_short_changed).alias(name))
    none = F.array().cast(publication.df.schema["terms"].dataType)
    both = (publication.df.join(side("delete", "_del"), "s", "left").join(side("insert", "_ins"), "s", "full_outer")
            .select("s", *[F.coalesce(c, none).alias(c) for c in ("terms", "_del", "_ins")]))
    after = SubjectRows(both.select("s", F.array_union(F.array_except("terms", "_del"), "_ins").alias("terms"))).frame()
    return after.where(F.col("s").isNotNull()).unionByName(after.where(F.col("s").isNull()).distinct())
