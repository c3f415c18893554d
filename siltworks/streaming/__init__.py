"""Row-local stages on streams. Uniqueness over a stream is told within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import Contract, FieldSpec, TransformSpec
from ..operators.assemble import transform
from ..operators.validate import validate


def without_uniqueness(contract: Contract) -> Contract:
    return Contract(contract.name, tuple(FieldSpec(**{**f.__dict__, "unique": False}) for f in contract.fields), contract.rules, contract.version, contract.description)


def conform_stream(rows: DataFrame, contract: Contract, mapping: dict[str, str | None], specs: list[TransformSpec], defaults: dict[str, str] | None = None) -> DataFrame:
    """A stream of rows (row_index, source columns) -> transformed rows with issues and status; no state is kept."""
    provided = {t for t in mapping.values() if t} | set(defaults or {})
    return validate(transform(rows, contract, mapping, specs, defaults), without_uniqueness(contract), provided)


def first_of_each(stream: DataFrame, field: str, time: str, delay: str) -> DataFrame:
    """The first row of each value of a unique field within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([field])
