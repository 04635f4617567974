"""Settings from YAML, checked on the driver: unknown or unsupported values raise and are named."""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass
from pathlib import Path

import yaml

from ..errors import ConfigError, MissingInput
from ..operators.bootstrap import BootstrapConfig
from ..operators.kernels import KERNELS
from ..operators.lunisolar import Festival
from ..operators.panel import CLOSED_FORMS, PanelConfig
from ..operators.planning import BASES, BEST_CLEAN, Ratio
from ..sources.ingest import TableSpec

REGISTRY = (*CLOSED_FORMS, *KERNELS)
NEEDS_CALENDAR = ("sarimax_cal",)
# name, treatment, control: what one setting changes
ABLATIONS = (("calendar", "sarimax_cal", "sarima"), ("switch", "switching", "holt_winters_add"), ("exit rule", "switching_sticky", "switching"))


def check_registry(registry=REGISTRY, needs_calendar=NEEDS_CALENDAR, ablations=ABLATIONS) -> None:
    """Names are unique, flags and ablations refer to registered forecasters, and no forecaster is compared with itself."""
    if len(set(registry)) != len(registry):
        raise ConfigError("a forecaster is registered twice")
    if unknown := set(needs_calendar) - set(registry):
        raise ConfigError(f"unknown forecasters need a calendar: {sorted(unknown)}")
    if len({a[0] for a in ablations}) != len(ablations):
        raise ConfigError("an ablation is named twice")
    for name, treatment, control in ablations:
        if treatment == control or {treatment, control} - set(registry):
            raise ConfigError(f"ablation {name}: {treatment} against {control}")
        if name == "calendar" and (treatment in needs_calendar) == (control in needs_calendar):
            raise ConfigError("the calendar ablation has to compare forecasters with and without one")


check_registry()


@dataclass(frozen=True)
class BacktestConfig:
    panel: PanelConfig
    models: tuple[str, ...]
    bootstrap: BootstrapConfig
    config_hash: str
    rectangular: bool = True

    @property
    def excluded(self) -> list[str]:
        """Registered forecasters that the file leaves out."""
        return sorted(set(REGISTRY) - set(self.models))


def _read(path: str) -> tuple[dict, str]:
    if not Path(path).exists():
        raise MissingInput(path)
    text = Path(path).read_text()
    return yaml.safe_load(text) or {}, hashlib.sha256(text.encode()).hexdigest()[:12]


def load_backtest(path: str) -> BacktestConfig:
    raw, digest = _read(path)
    if raw.get("window", "expanding") != "expanding" or raw.get("on_model_failure", "fail") != "fail":
        raise ConfigError(f"{path}: only an expanding window and on_model_failure: fail are supported")
    models = tuple(raw.get("models") or ())
    if not models or (unknown := set(models) - set(REGISTRY)):
        raise ConfigError(f"{path}: " + (f"unknown models {sorted(unknown)}" if models else "no models"))
    at = raw.get("origins") or {}
    panel = PanelConfig(int(at.get("min_train_months", 120)), tuple(raw.get("horizons") or ()), int(at.get("step_months", 1)), int((raw.get("metrics") or {}).get("mase_seasonality", 12)))
    b = raw.get("bootstrap") or {}
    if b.get("metric", "mase") != "mase" or not 0 < float(b.get("confidence", 0.95)) < 1:
        raise ConfigError(f"{path}: bootstrap metric or confidence")
    return BacktestConfig(panel, models, BootstrapConfig(int(b.get("n_resamples", 2000)), int(b.get("block_origins", 12)), float(b.get("confidence", 0.95)), b.get("seed", raw.get("seed", 0))), digest, bool(raw.get("rectangular", True)))


def load_festivals(path: str) -> tuple[Festival, ...]:
    """Festival rules; the scheme of month names has to be declared."""
    raw, _ = _read(path)
    if raw.get("lunar_month_scheme") != "purnimanta":
        raise ConfigError(f"{path}: lunar_month_scheme has to be purnimanta")
    out = [Festival(f["id"], **f["rule"], days=int(f.get("duration_days", 1))) for f in raw.get("festivals") or ()]
    if not out or len({f.id for f in out}) != len(out):
        raise ConfigError(f"{path}: festivals are missing or repeat an id")
    return tuple(out)


def load_range(path: str) -> tuple[dt.date, dt.date]:
    """First and last day of the calendar."""
    raw, _ = _read(path)
    span = raw.get("range") or {}
    if not all(isinstance(span.get(k), dt.date) for k in ("start", "end")) or span["end"] < span["start"]:
        raise ConfigError(f"{path}: range needs a start and a later end")
    return span["start"], span["end"]


def load_arms(path: str, declared: str) -> list[tuple[str, str]]:
    """(name, window file) of the arms of a sensitivity run, that of the declared windows first: at least two, differently named."""
    raw, _ = _read(path)
    entries = (raw.get("sensitivity") or {}).get("arms") or ()
    if any(not a.get(k) for a in entries for k in ("name", "shocks")):
        raise ConfigError(f"{path}: an arm needs a name and shocks")
    arms = [("declared", declared), *((str(a["name"]), str(a["shocks"])) for a in entries)]
    if len(arms) < 2 or len({n for n, _ in arms}) != len(arms):
        raise ConfigError(f"{path}: needs two or more arms with different names")
    return arms


@dataclass(frozen=True)
class OperationsConfig:
    model: str
    horizons: tuple[int, ...]
    confidence: float
    ratios: tuple[Ratio, ...]


def load_operations(path: str) -> OperationsConfig:
    """What to forecast with, how far, and the resources to plan; a ratio has to state its basis."""
    raw, _ = _read(path)
    model = str(raw.get("model", BEST_CLEAN))
    if model not in (BEST_CLEAN, *REGISTRY):
        raise ConfigError(f"{path}: unknown model {model!r}")
    horizons = tuple(sorted({int(h) for h in raw.get("horizons", range(1, 7))}))
    PanelConfig(horizons=horizons)
    confidence = float(raw.get("confidence", 0.9))
    if not 0 < confidence < 1:
        raise ConfigError(f"{path}: confidence {confidence}")
    ratios = []
    for r in (raw.get("planning") or {}).get("ratios") or ():
        if lacking := {"id", "per_pilgrims", "basis"} - set(r):
            raise ConfigError(f"{path}: a ratio lacks {', '.join(sorted(lacking))}")
        if r["basis"] not in BASES:
            raise ConfigError(f"{path}: {r['id']} has basis {r['basis']!r}; known are {', '.join(BASES)}")
        ratios.append(Ratio(str(r["id"]), float(r["per_pilgrims"]), r["basis"], int(r.get("minimum", 0))))
    return OperationsConfig(model, horizons, confidence, tuple(ratios))


@dataclass(frozen=True)
class IngestFile:
    path: str
    spec: TableSpec
    sheet: str | None = None


def load_ingest(path: str) -> tuple[dict[str, IngestFile], dict[str, str]]:
    """The monthly and the annual table to bring in, and their source. Both are required: only published totals catch a dropped digit."""
    raw, _ = _read(path)
    source = raw.get("source") or {}
    blank = [k for k in ("id", "publisher", "title", "accessed") if not source.get(k)]
    if blank or any("CHANGE ME" in str(v).replace("-", " ") for v in source.values()):
        raise ConfigError(f"{path}: source lacks {', '.join(blank) or 'real values'}")
    out = {}
    for section, key in (("monthly", "month"), ("annual", "year")):
        block = raw.get(section) or {}
        if lacking := [k for k in ("path", "columns", "unit") if k not in block]:
            raise ConfigError(f"{path}: {section} lacks {', '.join(lacking)}")
        columns = block["columns"]
        if lacking := [k for k in (key, "pilgrims") if k not in columns]:
            raise ConfigError(f"{path}: {section}.columns lacks {', '.join(lacking)}")
        form = block.get("month_format", "") if section == "monthly" else "%Y"
        out[section] = IngestFile(str(block["path"]), TableSpec(str(columns[key]), str(columns["pilgrims"]), form, str(block["unit"]), str(source["id"])), block.get("sheet"))
    return out, {k: str(v) for k, v in source.items()}
