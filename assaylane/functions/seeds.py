from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylane.fixed import SEED


def seed_hash(*ids: Column | str, seed: int = SEED) -> Column:
    """Seeded order key of a row: 32 hex digits that depend only on the seed and the row's id.

    Ordering by it shuffles rows the same way on any cluster and for any partitioning.
    """
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
