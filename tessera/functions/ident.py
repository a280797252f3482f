"""Identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def document_id(*parts: Column, size: int = 16) -> Column:
    """bytes of the SHA-1 of the parts joined by '/', each modulo 62, as letters."""
    digest = F.sha1(F.concat_ws("/", *parts))
    letters = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.substr(F.lit(ALPHABET), (F.conv(digest.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int") % 62) + 1, F.lit(1)))
    return F.array_join(letters, "")


def catalog_id(upstream: Column, own: Column, minted: Column, prefix: str = "up_") -> Column:
    """The upstream id, else the own id if it has the upstream form (``prefix``), else the minted one."""
    return F.coalesce(F.nullif(F.trim(upstream), F.lit("")), F.when(own.startswith(prefix), own), minted)
