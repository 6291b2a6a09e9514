"""Permission masks: who may do what to a partition."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATIONS = ("create", "update", "read", "delete")


class Denied(PermissionError):
    """The caller's groups lack a permission."""


def allowed(mask: Column, groups: int) -> Column:
    """A mask of 0 admits everyone, another one its groups."""
    return (mask == 0) | (mask.bitwiseAND(F.lit(groups)) != 0)


def admits(mask: int, groups: int) -> bool:
    return mask == 0 or mask & groups != 0


def authorise(partitions: Mapping[str, Mapping[str, int]], referenced: Iterable[str], operation: str, groups: int) -> None:
    """Raise unless every referenced partition admits the operation; unknown
    partitions admit everything."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    for name in referenced:
        if not admits(partitions.get(name, {}).get(operation, 0), groups):
            raise Denied(f"{operation} on {name}")


def next_group_bit(used: Iterable[int]) -> int:
    """The lowest free bit of 1 to 63."""
    taken = set(used)
    for bit in range(1, 64):
        if bit not in taken:
            return bit
    raise ValueError("all 63 group bits are in use")
