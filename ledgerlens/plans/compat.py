"""How a changed collection contract reads the rows that are stored under it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Judgement:
    """``invisible``: nothing that rows depend on changed; ``additive``: every stored row keeps its meaning, if
    ``verify_keys`` and ``absent_annotations`` hold for the stored rows; ``reinterpreting``: see ``reasons``."""

    verdict: str
    reasons: tuple[str, ...] = ()
    verify_keys: tuple[str, ...] = ()
    absent_annotations: tuple[str, ...] = ()
    added_properties: tuple[str, ...] = ()
    added_fields: tuple[str, ...] = ()
    repointed: tuple[str, ...] = ()


def same(a: Any, b: Any) -> bool:
    """Equality of JSON values: true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, Mapping) and isinstance(b, Mapping):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def _schema_reasons(old: Mapping[str, Any], new: Mapping[str, Any]) -> list[str]:
    out = [f"schema.{k} changed" for k in sorted({*old, *new} - {"properties", "required", "additionalProperties"}) if not same(old.get(k), new.get(k))]
    before, after = set(old.get("required", ())), set(new.get("required", ()))
    out += [f"schema.required gained {n}" for n in sorted(after - before)] + [f"schema.required dropped {n}" for n in sorted(before - after)]
    was, now = old.get("additionalProperties", True), new.get("additionalProperties", True)
    if not same(was, now) and not (was is False and now is True):
        out.append("schema.additionalProperties narrowed")
    fresh = new.get("properties") or {}
    for name, rule in sorted((old.get("properties") or {}).items()):
        if name not in fresh:
            out.append(f"schema.properties.{name} removed")
        elif not same(rule, fresh[name]):
            out.append(f"schema.properties.{name} redefined")
    return out


def _newer(old: Mapping[str, Any], new: Mapping[str, Any], supersedes: Mapping[str, str]) -> str | None:
    """The annotation that a field is pointed to, if it supersedes the one before and nothing else changed."""
    a, b = old.get("annotation"), new.get("annotation")
    if not a or not b or not same({k: v for k, v in old.items() if k != "annotation"}, {k: v for k, v in new.items() if k != "annotation"}):
        return None
    step, seen = supersedes.get(b), {b}
    while step and step not in seen:
        if step == a:
            return b
        seen.add(step)
        step = supersedes.get(step)
    return None


def judge(old: Mapping[str, Any], new: Mapping[str, Any], supersedes: Mapping[str, str] | None = None) -> Judgement:
    """Both definitions have one name and version. ``supersedes``: newer annotation to the one that it replaces."""
    if (old.get("name"), old.get("version", 1)) != (new.get("name"), new.get("version", 1)):
        raise ValueError("only one name and version of a collection can be compared")
    from ledgerlens.plans.catalog import contract_hash

    if contract_hash(old) == contract_hash(new):
        return Judgement("invisible")
    reasons = [f"{k} changed" for k in ("mode", "text_projection") if old.get(k) != new.get(k)]
    if set(old.get("required_processors") or ()) != set(new.get("required_processors") or ()):
        reasons.append("required_processors changed")
    before, after = old.get("fields") or {}, new.get("fields") or {}
    repointed, absent = [], []
    for name, rule in sorted(before.items()):
        if name not in after:
            reasons.append(f"fields.{name} removed")
        elif not same(rule, after[name]):
            newer = _newer(rule, after[name], supersedes or {})
            if newer is None:
                reasons.append(f"fields.{name} redefined")
            else:
                repointed.append(name)
                absent.append(newer)
    was, now = old.get("schema") or {}, new.get("schema") or {}
    reasons += _schema_reasons(was, now)
    added = sorted(set(now.get("properties") or {}) - set(was.get("properties") or {}))
    open_ = was.get("additionalProperties", True) is not False  # any value may be stored under a key that was not declared
    return Judgement("reinterpreting" if reasons else "additive", tuple(reasons), tuple(added) if open_ else (), tuple(sorted(set(absent))), tuple(added), tuple(sorted(set(after) - set(before))), tuple(repointed))
