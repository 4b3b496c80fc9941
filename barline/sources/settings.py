"""Configuration: a mapping with defaults, checks, and shadow copies with one change. Driver-side, small."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from dataclasses import dataclass

#: Sections that a configuration must have, and defaults of those that it may leave out.
REQUIRED = ("TRADING", "INDICATORS", "ENTRY_RULES", "EXIT_RULES", "POSITION_SIZING", "SIGNAL")
DEFAULTS = {
    "MEMORY": {"root": "memory/", "digest_window": 30},
    "GATE": {"invoke_on_volume_spike": True, "invoke_on_bos": True, "invoke_on_session_open": True},
    "CALENDAR": {"enabled": True, "lead_minutes": 15, "lag_minutes": 15},
}
LENSES = {"flow", "structure", "context", "intent"}
#: Rules that a change may tighten but not loosen: value and whether smaller is looser.
FIREWALL = {
    "MIN_KILL_THESIS_LEN": (40, True), "MIN_RR_MULTIPLE": (3.0, True), "MIN_NONZERO_LENSES": (2, True),
    "MAX_CONFIDENCE": (0.90, False), "CONFIDENCE_RECONCILE_TOLERANCE": (0.05, False),
}


class ConfigError(ValueError):
    pass


def parse(text: str) -> dict:
    """A hypothesis or configuration from JSON, or from YAML where a parser is installed."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("not JSON, and no YAML parser is installed") from e
        return yaml.safe_load(text)


#: What a configuration must satisfy: the failing value's name, and the test of a whole configuration.
CHECKS = (
    ("TRADING.account_risk_pct must be in (0, 10]", lambda c: 0 < (c["TRADING"].get("account_risk_pct") or 0) <= 10),
    ("EXIT_RULES.tp_distances needs three values", lambda c: len(c["EXIT_RULES"].get("tp_distances") or ()) >= 3),
)


def checked(config: dict, env: dict | None = None) -> dict:
    """The configuration with defaults, with values `SECTION__key` of env over empty ones, and checked."""
    if missing := [s for s in REQUIRED if s not in config]:
        raise ConfigError(f"missing sections: {missing}")
    merged = {s: {**DEFAULTS.get(s, {}), **config.get(s, {})} if s in DEFAULTS else v for s, v in {**DEFAULTS, **config}.items()}
    out = copy.deepcopy(merged)
    named = (name.partition("__") + (value,) for name, value in (env or {}).items())
    for section, _, key, value in named:
        if key and isinstance(out.get(section), dict) and not out[section].get(key):
            out[section][key] = value
    if failed := [text for text, good in CHECKS if not good(out)]:
        raise ConfigError("; ".join(failed))
    return out


def _is_text(x) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _is_weights(x) -> bool:
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0
    return isinstance(x, dict) and set(x) <= LENSES and all(map(number, x.values()))


@dataclass(frozen=True)
class Target:
    """Where a change goes. keys: the diff's keys that may hold the value, the first with one wins; good: a test of it.
    place: the path in the configuration, or, if None, the diff's own `path`; named: keys of the name that ends the path.
    how: set the value there, merge it into the mapping there, or add it to the list there."""

    keys: tuple[str, ...]
    good: Callable[[object], bool]
    place: tuple[str, ...] | None
    how: str = "set"
    named: tuple[str, ...] = ()


#: Fixed values of the change format: targets and the keys of their diffs.
TARGETS = {
    "config_threshold": Target(("after",), lambda x: True, None),
    "validate_take_rule": Target(("text", "after"), _is_text, ("_RULES",), "add"),
    "lens_weight": Target(("weights", "after"), _is_weights, ("LENS_WEIGHTS",), "merge"),
    "setup_file": Target(("body", "after", "text"), _is_text, ("_SETUPS",), named=("name", "filename")),
    "addendum_section": Target(("text", "after"), _is_text, ("_ADDENDA",), "add"),
    "confidence_calibration": Target(("table", "after"), lambda x: isinstance(x, dict), ("CONFIDENCE_CALIBRATION_TABLE",)),
}
_NONE = object()


def placed(tree: dict, path: tuple[str, ...], value, how: str) -> dict:
    """A copy of tree with the value at the path; what isn't a mapping on the way is replaced by one."""
    head, rest = path[0], path[1:]
    if rest:
        inner = tree.get(head)
        return {**tree, head: placed(inner if isinstance(inner, dict) else {}, rest, value, how)}
    old = tree.get(head)
    new = {"set": lambda: value, "add": lambda: [*(old or []), value], "merge": lambda: {**(old or {}), **value}}[how]()
    return {**tree, head: new}


def shadow(base: dict, change: dict) -> dict:
    """A copy of `base` with one change {change_id, tier, target, diff} applied and recorded as pending."""
    diff = change.get("diff") or {}
    if change.get("target") not in TARGETS:
        raise ValueError(f"unknown target {change.get('target')!r}")
    target = TARGETS[change["target"]]

    def given(keys: tuple[str, ...], good: Callable[[object], bool]):
        value = next((diff[k] for k in keys if diff.get(k)), diff.get(keys[-1], _NONE))
        if value is _NONE or not good(value):
            raise ValueError(f"{change['target']} needs a fit value under one of {keys}")
        return value

    value = given(target.keys, target.good)
    path = target.place if target.place is not None else tuple(given(("path",), lambda x: isinstance(x, list) and bool(x)))
    if target.named:
        path += (given(target.named, _is_text).strip(),)
    out = placed(copy.deepcopy(base), path, copy.deepcopy(value.strip() if change["target"] == "validate_take_rule" else value), target.how)
    return placed(out, ("_PENDING",), {k: change.get(k) for k in ("change_id", "tier", "target", "diff")}, "add")


def loosened(diff: dict) -> list[str]:
    """Names of firewall rules that a change would loosen, or names without a number to compare."""
    parts = [diff, *(x for x in diff.get("changes") or [] if isinstance(x, dict))]
    named = []
    for p in parts:
        path = p.get("path")
        last = path[-1] if isinstance(path, list) and path else None
        named += [(n, p.get("after")) for n in (p.get("constant"), last) if isinstance(n, str)]
    bad = []
    for name, after in named:
        if name in FIREWALL:
            now, smaller_is_looser = FIREWALL[name]
            if not isinstance(after, (int, float)) or (after < now if smaller_is_looser else after > now):
                bad.append(name)
    return bad
