"""The six stored tables as one set of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

_SCHEMAS = {
    "users": schemas.USERS,
    "categories": schemas.CATEGORIES,
    "suppliers": schemas.SUPPLIERS,
    "products": schemas.PRODUCTS,
    "product_batches": schemas.PRODUCT_BATCHES,
    "transactions": schemas.TRANSACTIONS,
}


class Tables:
    """What every plan reads: a DataFrame per table, built when first asked for.

    Some columns a source may only be able to supply through a join. Plans that do not
    need them read the narrow form: ``movements`` is the ledger without unit price and
    customer name, ``stock`` the batches without prices. ``complete`` adds the ledger's
    missing columns to some movements; ``bought`` adds those that hang on a movement's bill,
    ``priced`` those that hang on a product, to any rows with a ``product_id``. Where tables
    are stored whole, the narrow forms are the tables themselves.

    ``entries`` are the movements by the columns that their others are worked out from, each
    by its expression in ``spelling``; plans that send every movement over the network send
    these. ``spelled`` gives such a column. Where the ledger is stored whole, nothing is worked
    out and the entries are the movements.
    """

    users: DataFrame
    categories: DataFrame
    suppliers: DataFrame
    products: DataFrame
    product_batches: DataFrame
    transactions: DataFrame
    movements: DataFrame
    entries: DataFrame
    stock: DataFrame

    def __init__(
        self,
        as_of: date,
        complete: Callable[[DataFrame, bool], DataFrame] | None = None,
        bought: Callable[[DataFrame], DataFrame] | None = None,
        priced: Callable[[DataFrame], DataFrame] | None = None,
        spelling: dict[str, Column] | None = None,
        **tables: DataFrame | Callable[[], DataFrame],
    ):
        self.as_of = as_of
        self._complete, self._bought, self._priced, self._spelling = complete, bought, priced, spelling or {}
        self._tables = tables

    def complete(self, movements: DataFrame, few: bool = False) -> DataFrame:
        """Ledger rows of these movements; ``few`` says that they are a written page."""
        return movements if self._complete is None else self._complete(movements, few)

    def bought(self, movements: DataFrame) -> DataFrame:
        return movements if self._bought is None else self._bought(movements)

    def priced(self, rows: DataFrame) -> DataFrame:
        return rows if self._priced is None else self._priced(rows)

    def spelled(self, name: str) -> Column:
        """A movement's column, worked out from its entry."""
        return self._spelling.get(name, F.col(name))

    def __getattr__(self, name: str) -> DataFrame:
        # Only reached while the attribute has not been built.
        tables = self.__dict__["_tables"]
        wide = {"movements": "transactions", "entries": "movements", "stock": "product_batches"}.get(name)
        if wide and name not in tables:
            return getattr(self, wide)
        if name not in tables:
            raise AttributeError(name)
        source = tables[name]
        frame = source if isinstance(source, DataFrame) else source()
        setattr(self, name, frame)
        return frame

    def replaced(self, **tables: DataFrame | Callable[[], DataFrame]) -> Tables:
        kept, spelling = self._tables, self._spelling
        if "movements" in tables and "entries" not in tables:
            kept, spelling = {name: table for name, table in kept.items() if name != "entries"}, None
        return Tables(self.as_of, self._complete, self._bought, self._priced, spelling, **{**kept, **tables})


def read_parquet(spark: SparkSession, root: str, as_of: date) -> Tables:
    """Tables stored as one Parquet folder each; the ledger may be partitioned by ``txn_day``."""

    def load(name: str) -> DataFrame:
        return spark.read.schema(_SCHEMAS[name]).parquet(f"{root}/{name}")

    return Tables(as_of, **{name: partial(load, name) for name in _SCHEMAS})


def read_jdbc(
    spark: SparkSession,
    url: str,
    as_of: date,
    *,
    id_ranges: dict[str, tuple[int, int]] | None = None,
    connections: int = 10,
    properties: dict[str, str] | None = None,
) -> Tables:
    """Tables of an external database, read in parallel over id ranges.

    ``id_ranges`` gives the lowest and highest id of the tables worth splitting; at
    most ``connections`` tasks read one table at a time.
    """
    properties = properties or {}
    id_ranges = id_ranges or {}

    def load(name: str) -> DataFrame:
        if name not in id_ranges:
            return spark.read.jdbc(url, name, properties=properties)
        low, high = id_ranges[name]
        return spark.read.jdbc(
            url, name, column="id", lowerBound=low, upperBound=high, numPartitions=connections, properties=properties
        )

    return Tables(as_of, **{name: partial(load, name) for name in _SCHEMAS})
