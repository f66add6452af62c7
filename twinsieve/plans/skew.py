"""Joins of rows with one row per key, whose number of rows is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.plans.workspace import Workspace

#: Rows of one key that one task may take.
HOT_KEY_ROWS = 1_000_000
#: Hot keys up to which their salts are broadcast; of more, they are joined by a shuffle.
BROADCAST_HOT_KEYS = 100_000


class SizedKeys:
    """A table with unique ``keys`` and the row count of each in ``rows``.

    It is written out to learn how many keys are hot, unless ``n_hot`` tells.
    ``join`` attaches it to the rows it was counted from. Keys beyond
    HOT_KEY_ROWS are spread over as many tasks as their size asks for: their
    rows get a salt and their table row is repeated once per salt.
    """

    def __init__(self, ws: Workspace, counted: DataFrame, keys: list[str], rows: str = "n",
                 label: str = "keys", n_hot: int | None = None):
        self.ws, self.keys, self.rows = ws, keys, rows
        self.df, self.n_hot = counted, n_hot
        if n_hot is None:
            self.df, seen = ws.save_counted(counted, label, hot=F.count_if(F.col(rows) > HOT_KEY_ROWS))
            self.n_hot = seen["hot"] or 0

    def join(self, rows: DataFrame) -> DataFrame:
        if not self.n_hot:
            return rows.join(self.df, self.keys)
        salts = F.ceil(F.col(self.rows) / HOT_KEY_ROWS)
        hot = self.df.where(F.col(self.rows) > HOT_KEY_ROWS).select(*self.keys, salts.alias("salts"))
        hot = F.broadcast(hot) if self.n_hot <= BROADCAST_HOT_KEYS else hot
        salted = rows.join(hot, self.keys, "left").withColumn(
            "salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("salts", F.lit(1).cast("bigint")))).drop("salts")
        every = F.sequence(F.lit(0).cast("bigint"), F.greatest(salts, F.lit(1).cast("bigint")) - 1)
        return salted.join(self.df.withColumn("salt", F.explode(every)), [*self.keys, "salt"]).drop("salt")
