"""Identifier expressions and the registry of identifier converters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnFn = Callable[[Column], Column]


def zero_filled(col: Column, width: int = 8) -> Column:
    """Left-pad station ids with zeros; longer ids keep all their characters."""
    text = col.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def number_of(col: Column) -> Column:
    """Number behind the dash of ids such as ``wb-12`` or ``nex-12.0``."""
    return F.split_part(col, F.lit("-"), F.lit(2)).cast("double").cast("int")


def strip_prefix(col: Column, prefix: str) -> Column:
    return F.regexp_replace(col, f"^{prefix}-", "")


def with_prefix(col: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "-"), col.cast("string"))


def bucket_and_prefix(uri: str) -> tuple[str, str]:
    """Split an object-store address into bucket and key prefix."""
    rest = uri.split("://", 1)[1]
    bucket, _, prefix = rest.partition("/")
    return bucket, prefix


@dataclass(frozen=True)
class IdConverter:
    """Pair of expressions that map source ids to stored integers and back."""

    to_number: ColumnFn
    from_number: ColumnFn


_INTEGER = IdConverter(lambda c: c.cast("int"), lambda c: c.cast("int"))
_PREFIXED = IdConverter(number_of, lambda c: with_prefix(c.cast("int"), "wb"))

# Names under which stored networks declare their data set
_REGISTRY: dict[str, IdConverter] = {"merit": _INTEGER, "lynker": _PREFIXED, "hydrofabric_v2.2": _PREFIXED}


def converter_for(dataset: str) -> IdConverter:
    try:
        return _REGISTRY[dataset]
    except KeyError:
        raise ValueError(f"unknown dataset {dataset!r}; available: {', '.join(registered())}") from None


def register_converter(dataset: str, converter: IdConverter) -> None:
    _REGISTRY[dataset] = converter


def registered() -> list[str]:
    return sorted(_REGISTRY)
