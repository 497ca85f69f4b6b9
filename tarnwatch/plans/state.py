"""Steps as versioned JSON: what a fold leaves behind for the next one, checked when it is read."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass

import numpy as np

STATE_VERSION = 1
MAX_STATE_BYTES = 256 << 20


def _out(v):
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    if isinstance(v, (np.integer, np.floating)):
        return v.item()
    if isinstance(v, bytes):
        return {"bytes": v.hex()}
    if isinstance(v, np.ndarray):
        return {"array": v.tolist(), "type": v.dtype.str}
    if isinstance(v, (list, tuple)):
        return {"list": [_out(x) for x in v]}
    if isinstance(v, dict):
        return {"map": [[_out(k), _out(x)] for k, x in v.items()]}
    names = [f.name for f in fields(v)] if is_dataclass(v) else list(vars(v))
    return {"kind": type(v).__name__, "state": {n: _out(getattr(v, n)) for n in names}}


def _in(x, kinds: dict):
    if not isinstance(x, dict):
        return x
    if "bytes" in x:
        return bytes.fromhex(x["bytes"])
    if "array" in x:
        return np.array(x["array"], np.dtype(x["type"]))
    if "list" in x:
        return [_in(v, kinds) for v in x["list"]]
    if "map" in x:
        return {_in(k, kinds): _in(v, kinds) for k, v in x["map"]}
    kind = kinds.get(x.get("kind"))
    if kind is None:
        raise ValueError(f"unknown state {x.get('kind')!r}")
    values = {n: _in(v, kinds) for n, v in x["state"].items()}
    if is_dataclass(kind):
        known = {f.name for f in fields(kind)}
        if set(values) - known:
            raise ValueError(f"unknown fields {sorted(set(values) - known)} of {kind.__name__}")
        return kind(**values)  # runs the checks of a new one
    out = kind()
    if set(values) - set(vars(out)):
        raise ValueError(f"unknown fields of {kind.__name__}")
    vars(out).update(values)
    return out


def dump(step) -> bytes:
    return json.dumps({"version": STATE_VERSION, "step": _out(step)}).encode()


def load(raw: bytes, like):
    """The step of ``raw``, which must be of ``like``'s kind."""
    from ..operators import steps

    if len(raw) > MAX_STATE_BYTES:
        raise ValueError("over the size limit")
    body = json.loads(bytes(raw))
    if body.get("version") != STATE_VERSION:
        raise ValueError(f"state version {body.get('version')}, expected {STATE_VERSION}")
    kinds = {n: k for n, k in vars(steps).items() if isinstance(k, type)} | {type(like).__name__: type(like)}
    step = _in(body["step"], kinds)
    if type(step) is not type(like):
        raise ValueError(f"a state of {type(step).__name__}, expected {type(like).__name__}")
    return step
