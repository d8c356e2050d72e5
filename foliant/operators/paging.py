"""Table functions over ordered partitions (E-04): rows of a key come one by one
in order, a small state is carried from row to row and any number of rows goes
out, so memory doesn't depend on how many rows a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BudgetTake:
    """O-05: takes what still fits; one row at the end of a key."""

    def __init__(self) -> None:
        self.key, self.taken, self.omitted, self.used, self.any = None, 0, 0, 0, False

    def eval(self, row, budget: int):
        self.any, self.key = True, row["key"]
        if row["size"] is not None and self.used + row["size"] <= budget:
            self.used += row["size"]
            self.taken += 1
        else:
            self.omitted += 1

    def terminate(self):
        if self.any:
            yield self.key, self.taken, self.omitted, self.used


class Pages:
    """X-08, H-09, O-09: numbers pages from 0; a row that would take its page over
    ``chars``, or be one more than ``most``, opens the next."""

    def __init__(self) -> None:
        self.page, self.rows, self.used = 0, 0, 0

    def eval(self, row, most: int, chars: int):
        size = row["size"] or 0
        if self.rows and (self.rows == most or self.used + size > chars):
            self.page, self.rows, self.used = self.page + 1, 0, 0
        self.rows += 1
        self.used += size
        yield row["key"], row["item"], self.page, self.rows, self.used


class BudgetPick:
    """O-05: whether each row is among what still fits its key's budget."""

    def __init__(self) -> None:
        self.used = 0

    def eval(self, row):
        fits = self.used + (row["size"] or 0) <= row["top"]
        self.used += (row["size"] or 0) if fits else 0
        yield row["key"], row["item"], fits


class HalvedBlocks:
    """O-09: numbers blocks of at most ``most`` rows, halving those that are too
    long; a block is all that is held."""

    def __init__(self) -> None:
        self.number, self.held = 0, []

    def eval(self, row, most: int, chars: int):
        self.held.append((row["key"], row["item"], row["size"] or 0))
        self.chars = chars
        if len(self.held) == most:
            yield from self._dealt(self.held)
            self.held = []

    def terminate(self):
        if self.held:
            yield from self._dealt(self.held)

    def _dealt(self, rows: list):
        if len(rows) > 1 and sum(s for _, _, s in rows) > self.chars:
            middle = -(-len(rows) // 2)
            yield from self._dealt(rows[:middle])
            yield from self._dealt(rows[middle:])
            return
        for key, item, _ in rows:
            yield key, item, self.number
        self.number += 1


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def budget_take(items: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """O-05: (key, taken, omitted, used) of each key: in order, what still fits
    into the budget is taken, what doesn't is passed over; a null size never
    fits."""
    rows = items.select(F.col(key).alias("key"), F.col(order).alias("item"), F.col(size).cast("long").alias("size"))
    take = F.udtf(BudgetTake, returnType=f"key {_kind(rows, 'key')}, taken long, omitted long, used long")
    got = take(rows.asTable().partitionBy("key").orderBy("item"), F.lit(budget))
    return got.select(F.col("key").alias(key), "taken", "omitted", "used")


def pages(items: DataFrame, key: str, order: str, size: Column, most: int, chars: int) -> DataFrame:
    """(key, order, page, row, used): each row's page within its key, its place on
    it from 1 and the size of the page so far; a null size counts as 0."""
    rows = items.select(F.col(key).alias("key"), F.col(order).alias("item"), size.cast("long").alias("size"))
    deal = F.udtf(Pages, returnType=f"key {_kind(rows, 'key')}, item {_kind(rows, 'item')}, page long, row long, used long")
    got = deal(rows.asTable().partitionBy("key").orderBy("item"), F.lit(most), F.lit(chars))
    return got.select(F.col("key").alias(key), F.col("item").alias(order), "page", "row", "used")


def _keyed(items: DataFrame, key: list[str], order: str, *more: Column) -> DataFrame:
    return items.select(F.struct(*key).alias("key"), F.col(order).alias("item"), *more)


def _back(items: DataFrame, got: DataFrame, key: list[str], order: str, name: str) -> DataFrame:
    """``items`` with what a table function said of each."""
    flags = got.select(*(F.col(f"key.{k}").alias(f"_{k}") for k in key), F.col("item").alias("_item"), name)
    on = F.col(order) == F.col("_item")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return items.join(flags, on).drop("_item", *(f"_{k}" for k in key))


def budget_pick(items: DataFrame, key: list[str], order: str, size: str, budget: Column) -> DataFrame:
    """O-05: ``items`` with taken, whether they are among what still fits, in
    order, into a key's ``budget``."""
    rows = _keyed(items, key, order, F.col(size).cast("long").alias("size"), budget.cast("long").alias("top"))
    pick = F.udtf(BudgetPick, returnType=f"key {_kind(rows, 'key')}, item {_kind(rows, 'item')}, taken boolean")
    return _back(items, pick(rows.asTable().partitionBy("key").orderBy("item")), key, order, "taken")


def halved_blocks(items: DataFrame, key: list[str], order: str, size: str, most: int, chars: int, name: str) -> DataFrame:
    """O-09: ``items`` with the number of their block within a key, from 0:
    ``most`` at a time in order, and a block of over ``chars`` characters is
    halved, the first half the longer one, until its parts fit or stand alone."""
    rows = _keyed(items, key, order, F.col(size).cast("long").alias("size"))
    deal = F.udtf(HalvedBlocks, returnType=f"key {_kind(rows, 'key')}, item {_kind(rows, 'item')}, `{name}` int")
    return _back(items, deal(rows.asTable().partitionBy("key").orderBy("item"), F.lit(most), F.lit(chars)), key, order, name)
