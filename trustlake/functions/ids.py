"""Artifact identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlake import constants as C
from trustlake.functions.numeric import col


def artifact_id(name: Column | str) -> Column:
    """SHA-256 of the UTF-8 name as an integer, modulo ``ID_MODULUS``.

    The 64 hex digits are folded in pieces of seven, so that each step
    ``acc * 16**7 + piece`` stays below 2**63.
    """
    digest = F.sha2(col(name).cast("binary"), 256)
    acc: Column = F.lit(0).cast("long")
    for start in range(1, 65, 7):
        width = min(7, 65 - start)
        piece = F.conv(F.substring(digest, start, width), 16, 10).cast("long")
        acc = (acc * F.lit(16**width).cast("long") + piece) % F.lit(C.ID_MODULUS)
    return acc
