"""Run configuration: nested dataclasses read from YAML or JSON; unknown keys are errors."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from datetime import date
from pathlib import Path

from rillflow.functions.hydraulics import DEFAULT_P_SPATIAL, LOG_SPACE, MINIMUMS, PARAMETER_RANGES, Physics
from rillflow.operators.resample import parse_day

MODES = ("training", "testing", "routing")


@dataclass
class DataSources:
    """Folders of the canonical tables."""

    network: str = ""
    reaches: str = ""
    attributes: str = ""
    statistics: str = ""
    streamflow: str = ""
    observations: str = ""
    gages: str = ""
    target_catchments: list = field(default_factory=list)
    is_hourly: bool = False


@dataclass
class Params:
    attribute_minimums: dict = field(default_factory=lambda: dict(MINIMUMS))
    parameter_ranges: dict = field(default_factory=lambda: {k: list(v) for k, v in PARAMETER_RANGES.items()})
    log_space_parameters: list = field(default_factory=lambda: list(LOG_SPACE))
    defaults: dict = field(default_factory=lambda: {"p_spatial": DEFAULT_P_SPATIAL})
    tau: int = 3
    save_path: str = "./"


@dataclass
class Kan:
    hidden_size: int = 11
    input_var_names: list = field(default_factory=list)
    num_hidden_layers: int = 1
    learnable_parameters: list = field(default_factory=lambda: ["n", "q_spatial"])
    grid: int = 3
    k: int = 3


@dataclass
class Experiment:
    start_time: str = "1981/10/01"
    end_time: str = "1995/09/30"
    batch_size: int = 1
    epochs: int = 1
    rho: int | None = None
    warmup: int = 3
    shuffle: bool = True
    checkpoint: str | None = None
    learning_rate: dict = field(default_factory=lambda: {1: 0.005})
    max_area_diff_sqkm: float | None = 50.0

    @property
    def first(self) -> date:
        return parse_day(self.start_time)

    @property
    def last(self) -> date:
        return parse_day(self.end_time)


@dataclass
class Config:
    name: str = "run"
    mode: str = "routing"
    geodataset: str = "merit"
    seed: int = 42
    data_sources: DataSources = field(default_factory=DataSources)
    params: Params = field(default_factory=Params)
    kan: Kan = field(default_factory=Kan)
    experiment: Experiment = field(default_factory=Experiment)

    @property
    def physics(self) -> Physics:
        """Ranges and defaults as the plans take them; what the file leaves out keeps its default."""
        ranges = {**PARAMETER_RANGES, **{k: tuple(map(float, v)) for k, v in self.params.parameter_ranges.items()}}
        defaults = {"p_spatial": DEFAULT_P_SPATIAL, **self.params.defaults}
        return Physics(ranges, tuple(self.params.log_space_parameters), defaults)

    def check(self) -> Config:
        from rillflow.functions.ids import converter_for

        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        converter_for(self.geodataset)
        if self.experiment.last < self.experiment.first:
            raise ValueError("end_time lies before start_time")
        days = (self.experiment.last - self.experiment.first).days + 1
        if self.experiment.rho is not None and self.experiment.rho > days:
            raise ValueError(f"rho of {self.experiment.rho} days exceeds the period of {days} days")
        unknown = set(self.kan.learnable_parameters) - set(self.params.parameter_ranges)
        if unknown:
            raise ValueError(f"no range for learnable parameters {sorted(unknown)}")
        # the routing scheme has these built in; a changed value must not be accepted and ignored
        if dict(self.params.attribute_minimums) != MINIMUMS:
            raise ValueError(f"attribute_minimums cannot be changed from {MINIMUMS}")
        if not self.experiment.shuffle:
            raise ValueError("gauge batches are always shuffled; shuffle must be true")
        return self


def _build(cls, values: dict, where: str):
    known = {f.name: f for f in fields(cls)}
    extra = set(values) - set(known)
    if extra:
        raise ValueError(f"unknown keys in {where or 'configuration'}: {sorted(extra)}")
    nested = {"data_sources": DataSources, "params": Params, "kan": Kan, "experiment": Experiment}
    made = {}
    for name, value in values.items():
        sub = nested.get(name) if cls is Config else None
        made[name] = _build(sub, value or {}, name) if sub and not is_dataclass(value) else value
    return cls(**made)


def load_config(path: str, overrides: list[str] | None = None) -> Config:
    """Read a file and apply ``section.key=value`` overrides."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as exc:
            raise ImportError("reading YAML needs PyYAML; use a JSON file instead") from exc
        values = yaml.safe_load(text) or {}
    else:
        values = json.loads(text)
    for item in overrides or []:
        key, _, raw = item.partition("=")
        at = values
        *parents, leaf = key.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        try:
            at[leaf] = json.loads(raw)
        except json.JSONDecodeError:
            at[leaf] = raw
    return _build(Config, values, "").check()


def save_config(config: Config, folder: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "config.json").write_text(json.dumps(asdict(config), indent=2, default=str))


def describe() -> str:
    """All settings and their defaults as Markdown tables."""
    out = []
    for section in (Config, DataSources, Params, Kan, Experiment):
        out += [f"### {section.__name__}", "", "| setting | type | default |", "|---|---|---|"]
        blank = section()
        for f in fields(section):
            value = getattr(blank, f.name)
            shown = f"see {type(value).__name__}" if is_dataclass(value) else f"`{value!r}`"
            out.append(f"| `{f.name}` | `{f.type}` | {shown} |")
        out.append("")
    return "\n".join(out)
