"""YAML configuration on the driver: universes, experiments, manifests and parameter grids, and the ids made of them."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from dataclasses import dataclass, field, replace
from typing import Any

try:
    import yaml
except ImportError:  # configuration files need it, nothing else does
    yaml = None

from ..schema import STEP_SECONDS


@dataclass(frozen=True)
class Universe:
    symbols: tuple[str, ...]
    start: str
    end: str | None
    market: str
    include_delisted: bool = True


@dataclass(frozen=True)
class Experiment:
    name: str
    strategy: str
    params: dict[str, Any]
    timeframe: str
    start: str
    end: str | None = None
    costs: dict[str, Any] = field(default_factory=dict)
    validation: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Cell:
    """One configuration of a grid; its index is part of the contract."""

    index: int
    config_id: str
    symbol: str
    experiment: Experiment


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def config_id(e: Experiment, symbol: str) -> str:
    """The same for the same hypothesis, whatever the order of keys; the experiment's name does not count."""
    own = {k: getattr(e, k) for k in ("strategy", "params", "timeframe", "start", "end", "costs", "validation")}
    return short_hash(canonical(own | {"symbol": symbol}))


def experiment_id(e: Experiment, data_version: str, revision: str) -> str:
    return short_hash(f"{canonical(e.__dict__)}|{data_version}|{revision}")


def _strict(path: str) -> dict:
    """A mapping from a YAML file in which no key occurs twice."""
    if yaml is None:
        raise RuntimeError("PyYAML is needed to read configuration files")

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        seen = set()
        for k, _ in node.value:
            name = loader.construct_object(k, deep=deep)
            if name in seen:
                raise ValueError(f"{path}: key {name!r} occurs twice")
            seen.add(name)
        return yaml.SafeLoader.construct_mapping(loader, node, deep)

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, lambda loader, node: mapping(loader, node, True))
    with open(path, encoding="utf-8") as f:
        data = yaml.load(f, Loader)  # noqa: S506
    if not isinstance(data, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return data


def _need(data: dict, names: tuple[str, ...], where: str) -> None:
    missing = [n for n in names if data.get(n) in (None, "")]
    if missing:
        raise ValueError(f"{where}: {', '.join(missing)} missing")


def _text(value: Any) -> str | None:
    return None if value is None else str(value)


def load_universe(path: str) -> Universe:
    data = _strict(path)
    _need(data, ("market", "start", "symbols"), path)
    symbols = [str(s) for s in data["symbols"]]
    if len(set(symbols)) != len(symbols):
        raise ValueError(f"{path}: a symbol occurs twice")
    delisted = data.get("include_delisted")
    if delisted is not None and not isinstance(delisted, bool):
        raise ValueError(f"{path}: include_delisted must be true or false")
    return Universe(tuple(symbols), str(data["start"]), _text(data.get("end")), str(data["market"]), True if delisted is None else delisted)


def experiment_of(data: dict, where: str) -> Experiment:
    _need(data, ("name", "strategy", "timeframe", "start"), where)
    if data["timeframe"] not in STEP_SECONDS:
        raise ValueError(f"{where}: unknown time frame {data['timeframe']!r}")
    parts = {k: data.get(k) or {} for k in ("params", "costs", "validation")}
    if any(not isinstance(v, dict) for v in parts.values()):
        raise ValueError(f"{where}: params, costs and validation must be mappings")
    return Experiment(str(data["name"]), str(data["strategy"]), parts["params"], data["timeframe"], str(data["start"]), _text(data.get("end")), parts["costs"], parts["validation"])


def load_experiment(path: str) -> Experiment:
    return experiment_of(_strict(path), path)


def load_manifest(path: str) -> list[str]:
    """Paths of a manifest, one a line, relative to it; # begins a comment."""
    with open(path, encoding="utf-8") as f:
        lines = [line.split("#", 1)[0].strip() for line in f]
    found = [os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), x)) for x in lines if x]
    if not found:
        raise ValueError(f"{path}: no entries")
    if len(set(found)) != len(found):
        raise ValueError(f"{path}: an entry occurs twice")
    if bad := [p for p in found if not os.path.isfile(p)]:
        raise FileNotFoundError(f"{path}: no file {bad[0]}")
    return found


def check_sweep(experiments: list[Experiment]) -> None:
    """A sweep compares hypotheses on the same bars: one time frame and range, no hypothesis twice (names don't count)."""
    if len({(e.timeframe, e.start, e.end) for e in experiments}) > 1:
        raise ValueError("configurations differ in time frame or range")
    ids = [config_id(e, "") for e in experiments]
    if len(set(ids)) != len(ids):
        raise ValueError("a hypothesis occurs twice")


def expand(base: Experiment, symbols: list[str], timeframes: list[str], axes: dict[str, list]) -> list[Cell]:
    """Symbols × time frames × parameter axes, the last axis fastest."""
    cells = []
    for symbol, timeframe, *values in itertools.product(symbols, timeframes, *axes.values()):
        e = replace(base, params={**base.params, **dict(zip(axes, values, strict=True))}, timeframe=timeframe)
        cells.append(Cell(len(cells), config_id(e, symbol), symbol, e))
    return cells


def load_grid(path: str) -> list[Cell]:
    data = _strict(path)
    if unknown := set(data) - {"experiment", "axes"}:
        raise ValueError(f"{path}: unknown sections {sorted(unknown)}")
    base = experiment_of(data.get("experiment") or {}, f"{path}: experiment")
    axes = data.get("axes") or {}
    if unknown := set(axes) - {"symbols", "timeframes", "params"}:
        raise ValueError(f"{path}: unknown axes {sorted(unknown)}")
    symbols, timeframes, params = axes.get("symbols"), axes.get("timeframes") or [base.timeframe], axes.get("params") or {}
    lists = {"symbols": symbols, "timeframes": timeframes, **params}
    for name, values in lists.items():
        if not isinstance(values, list) or not values:
            raise ValueError(f"{path}: {name} must be a list with entries")
        if len({canonical(v) for v in values}) != len(values):
            raise ValueError(f"{path}: {name} has an entry twice")
    if bad := [t for t in timeframes if t not in STEP_SECONDS]:
        raise ValueError(f"{path}: unknown time frame {bad[0]!r}")
    return expand(base, [str(s) for s in symbols], timeframes, params)
