"""Quality checks: each returns the violating rows or keys (CK1-CK3, AG7, JN9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schemas import REFERENCES, UNIQUE


def provenance_violations(df: DataFrame) -> DataFrame:
    """CK1: is_auto_generated must be NULL exactly when provenance_confidence is unknown."""
    return df.filter(F.col("is_auto_generated").isNull() != (F.col("provenance_confidence") == "unknown"))


def enum_violations(df: DataFrame, spec: Mapping[str, Sequence[str]], nullable: Sequence[str] = ()) -> DataFrame:
    """CK2: rows with a value outside its column's list, or NULL unless the column is nullable."""
    bad = [~F.col(c).isin(*allowed) | (F.lit(False) if c in nullable else F.col(c).isNull()) for c, allowed in spec.items()]
    return df.filter(reduce(or_, [F.coalesce(b, F.col(c).isNull() & F.lit(c not in nullable)) for b, c in zip(bad, spec, strict=True)]))


def shape_violations(df: DataFrame, not_null: Sequence[str] = (), lengths: Mapping[str, int] = {}, sizes: Mapping[str, int] = {}) -> DataFrame:
    """CK3: rows with NULL where none may be, a text longer than its limit, or an array of the wrong size."""
    bad = [F.col(c).isNull() for c in not_null] + [F.length(c) > n for c, n in lengths.items()] + [F.size(c) != n for c, n in sizes.items()]
    return df.filter(reduce(or_, [F.coalesce(b, F.lit(False)) for b in bad]))


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG7: keys that occur more than once, with n; keys with a NULL part are exempt."""
    whole = df.dropna(subset=list(keys))
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def fk_violations(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """JN9: child rows whose reference is not NULL and has no parent. Either side may be generated, so the join's strategy is set."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).hint("merge"), column, "left_anti")


def model_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """AG7, JN9 over the data model: (table_name, rule, violations) for each unique key and reference whose tables and columns are given.

    ``tables`` have the model's names; the key of a table t is its column t_id. A unique key counts the
    keys that occur more than once, a reference the rows without a parent; keys with a NULL part are exempt.

    Each table is read once: a row gives a key for every rule that it takes part in, as the one that must be unique, as child
    or as parent. All of them share one shuffle, in which equal keys are counted before they are sent, so a parent with very many
    children costs no more than one with few.
    """
    rules: list[tuple[int, str, str]] = []
    given: dict[str, list[Column]] = {t: [] for t in tables}

    def give(table: str, columns: Sequence[str], side: str) -> None:
        whole = reduce(and_, [F.col(c).isNotNull() for c in columns])
        key = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)]))
        given[table].append(F.struct(F.lit(len(rules)).alias("rule_id"), F.lit(side).alias("side"), F.when(whole, key).alias("key")))

    for t, keys in UNIQUE.items():
        if t in tables and set(keys) <= set(tables[t].columns):
            give(t, keys, "own")
            rules.append((len(rules), t, "unique " + ",".join(keys)))
    for child, column, parent, _ in REFERENCES:
        if child in tables and parent in tables and column in tables[child].columns:
            give(child, [column], "child")
            give(parent, [f"{parent}_id"], "parent")
            rules.append((len(rules), child, f"{column} in {parent}"))
    keyed = [tables[t].select(F.explode(F.array(*own)).alias("k")).select("k.*").filter("key is not null") for t, own in given.items() if own]
    counted = reduce(DataFrame.unionByName, keyed).groupBy("rule_id", "key").agg(
        F.count_if(F.col("side") == "own").alias("own"), F.count_if(F.col("side") == "child").alias("children"), F.count_if(F.col("side") == "parent").alias("parents")
    )
    bad = F.when(F.col("own") > 1, 1).when((F.col("children") > 0) & (F.col("parents") == 0), F.col("children")).otherwise(0)
    found = counted.groupBy("rule_id").agg(F.sum(bad).alias("violations"))
    named = found.sparkSession.createDataFrame(rules, "rule_id int, table_name string, rule string")  # the model's rules, some thirty
    return named.join(found.hint("merge"), "rule_id", "left").select("table_name", "rule", F.coalesce("violations", F.lit(0)).alias("violations"))
