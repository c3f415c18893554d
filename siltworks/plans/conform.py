"""Read, profile, map, transform, validate: the whole plan, and the state of a job as tables in a folder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFoundError, StateError
from ..model import Contract, TransformSpec, check_transforms, suggest_transforms
from ..operators import assemble, export, quality, review
from ..operators.mapping import merge_template, suggest
from ..operators.profile import profile
from ..operators.validate import all_issues, validate
from ..sources.delimited import extension, read_csv
from ..sources.tables import written
from ..sources.xlsx import read_xlsx, workbooks


def provided_fields(contract: Contract, mapping: dict[str, str | None], specs: list[TransformSpec], defaults: dict[str, str] | None = None) -> set[str]:
    """Fields that a column, a structural or default transformation or a job default fills."""
    out = {t for t in mapping.values() if t} | {n for n, v in (defaults or {}).items() if v}
    for s in specs:
        if s.enabled and s.kind in ("combine", "default") and s.target:
            out.add(s.target)
        elif s.enabled and s.kind == "split":
            out |= set(s.params.get("into", []))
    return out & set(contract.names)


def conform(rows: DataFrame, contract: Contract, mapping: dict[str, str | None], specs: list[TransformSpec] | None = None, defaults: dict[str, str] | None = None, edits: DataFrame | None = None, infer: bool = True) -> DataFrame:
    """Raw rows (row_index, source columns) -> row_index, fields, original, notes, issues, row_status."""
    specs = suggest_transforms(contract, mapping) if specs is None else check_transforms(contract, specs)
    if infer:
        specs = assemble.infer_date_order(rows, mapping, specs)
    transformed = assemble.transform(rows, contract, mapping, specs, defaults, review.overrides(edits) if edits is not None else None)
    return validate(transformed, contract, provided_fields(contract, mapping, specs, defaults))


@dataclass
class Job:
    """One import. Later steps are derived from earlier ones, so changing one leaves nothing stale to clear.

    Validated rows are written once. An edit validates the affected rows only and writes them to a second, small table, so
    neither a plan nor the time of an edit grows with the edits before it.
    """

    spark: SparkSession
    path: str
    contract: Contract | None = None
    sheet: str | None = None
    mapping: dict[str, str | None] = field(default_factory=dict)
    specs: list[TransformSpec] | None = None
    defaults: dict[str, str] = field(default_factory=dict)
    completed: bool = False
    template: str | None = None

    def __post_init__(self) -> None:
        self._edits: DataFrame | None = None
        self._events: list[tuple] = []
        self._base: DataFrame | None = None
        self._fresh: DataFrame | None = None
        self._counts: review.Counts | None = None
        self._built: tuple | None = None
        self.select_sheet(self.sheet)

    def select_sheet(self, sheet: str | None) -> None:
        self.sheet = sheet
        self.rows, self.meta = read_xlsx(self.spark, self.path, sheet) if extension(self.path) == ".xlsx" else read_csv(self.spark, self.path)
        self.mapping, self.specs, self.edits, self.completed = {}, None, None, False

    @property
    def edits(self) -> DataFrame | None:
        """The events in effect; setting them (after an undo, say) validates all rows again when they're next wanted."""
        return self._edits

    @edits.setter
    def edits(self, edits: DataFrame | None) -> None:
        self._edits = None if edits is None else written(edits)
        self._events, self._base, self._fresh, self._counts = [], None, None, None

    @property
    def status(self) -> str:
        return "completed" if self.completed else "mapped" if self.mapping else "mapping" if self.contract else "uploaded"

    def profile(self) -> DataFrame:
        return profile(self.rows, self.meta["columns"])

    def suggest_mapping(self, contract: Contract, memory: DataFrame | None = None) -> DataFrame:
        self.contract = contract
        sources = self.profile().select(F.col("column").alias("source"), F.col("index").alias("ordinal"), F.col("detected_type").alias("detected"))
        return suggest(sources, contract, memory)

    def confirm(self, mapping: dict[str, str | None]) -> None:
        if self.contract is None:
            raise StateError("choose a contract first")
        self.mapping, self.specs, self._base, self._fresh, self.completed = mapping, suggest_transforms(self.contract, mapping), None, None, False
        self._counts = None

    def apply_template(self, suggested: DataFrame, pairs: DataFrame, specs: list[TransformSpec] | None = None, name: str | None = None) -> DataFrame:
        """Confirm a suggested mapping with a template's pairs (key, target) put in, and its transformations, if it has any, in place of the job's. Returns that mapping."""
        merged = merge_template(suggested, pairs)
        self.confirm({r["source"]: r["target"] for r in merged.orderBy("ordinal").collect()})  # a row a header
        self.template = name
        if specs:
            self.specs = check_transforms(self.contract, specs)
        return merged

    def report(self, scope: str = "ready") -> DataFrame:
        view = self.validated()
        return export.report(view, self.issues(), self.contract.name, self.path.rsplit("/", 1)[-1], scope=scope, mapping=self.mapping, specs=self.specs or [], template=self.template)

    def workbooks(self, scope: str = "ready") -> DataFrame:
        """(book, content): the exported rows as workbooks, each with the report."""
        rows = export.guarded(self.exported(scope), self.contract.names)
        return workbooks(rows, self.contract.names, export.report_rows(self.report(scope).first()))

    def _plan(self) -> tuple:
        return self.contract, tuple(self.mapping.items()), tuple(map(repr, self.specs or [])), tuple(self.defaults.items())

    def validated(self) -> DataFrame:
        if not self.mapping:
            raise StateError("confirm a mapping first")
        if self._base is None or self._built != self._plan():
            specs = suggest_transforms(self.contract, self.mapping) if self.specs is None else self.specs
            self._inferred = assemble.infer_date_order(self.rows, self.mapping, check_transforms(self.contract, specs))
            self._base = written(conform(self.rows, self.contract, self.mapping, self._inferred, self.defaults, self._edits, infer=False))
            self._fresh, self._counts, self._built = None, None, self._plan()
        return self._base if self._fresh is None else review.merge(self._base, self._fresh)

    def issues(self) -> DataFrame:
        return all_issues(self.validated(), self.contract, self._provided())

    def _provided(self) -> set[str]:
        return provided_fields(self.contract, self.mapping, self.specs or [], self.defaults)

    def summary(self) -> DataFrame:
        return quality.summary(self.validated())

    def edit(self, row_index: int, name: str, value: str | None) -> None:
        """Put a value in a cell: an event at once, and the affected rows validated again."""
        view = self.validated()
        at = view.where(F.col("row_index") == row_index)
        was = at.first()
        if was is None:
            raise NotFoundError(f"there's no row {row_index}")
        if not self._events and self._edits is not None:
            self._events = [tuple(r) for r in self._edits.select("seq", "label", "row_index", "field", "before", "after").collect()]  # what was edited by hand
        seq = max((e[0] for e in self._events), default=0) + 1
        self._events.append((seq, "edit", row_index, name, was[name], None if value == "" else value))
        self._edits = self.spark.createDataFrame(self._events, review.EDITS)
        mine = self.spark.createDataFrame([e for e in self._events if e[2] == row_index], review.EDITS)
        row = self.rows.where(F.col("row_index") == row_index)
        now = assemble.transform(row, self.contract, self.mapping, self._inferred, self.defaults, review.overrides(mine))
        if self._counts is None:
            self._counts = review.Counts.of(view, self.contract)
        fresh, self._counts = review.revalidated(view, self._counts, now, self.contract, self._provided())
        self._fresh = written(fresh if self._fresh is None else review.merge(self._fresh, fresh))

    def exported(self, wanted: str = "ready") -> DataFrame:
        """The rows of a scope, for a sink; before a mapping is confirmed there's nothing to export."""
        return export.scope(self.validated(), wanted)

    def complete(self) -> None:
        self.validated()
        self.completed = True
