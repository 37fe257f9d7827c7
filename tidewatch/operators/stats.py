"""Plain steps of the statistics, for folds in Python and for streams."""

from __future__ import annotations

import math
from collections.abc import Callable


def stepper(stat) -> Callable:
    """A factory of (update, reset) for a Statistic of folds, with its params."""
    cells, name = stat.params, stat.name

    def make(state: dict | None = None):
        s = dict(state) if state else {"first": True, "value": 0.0, **stat_start}

        def update(x: float, dt: float = 1.0) -> float:
            if name == "i2t":
                over = max(0.0, x - cells["theta"])
                s["value"] = (s["value"] if s["first"] else s["value"] * math.exp(-dt / cells["tau"])) + over * over
            elif name == "cusum":
                s["value"] = max(0.0, s["value"] + (x - cells["k_ref"]))
            elif name == "ewma":
                s["value"] = x if s["first"] else cells["alpha"] * x + (1 - cells["alpha"]) * s["value"]
            else:
                _kalman(s, x, cells)
            s["first"] = False
            return s["value"]

        def reset() -> None:
            s.clear()
            s.update(first=True, value=0.0, **stat_start)

        update.state = s
        return update, reset

    stat_start = dict(stat.start)
    return make


def _kalman(s: dict, x: float, c: dict) -> None:
    if s["first"]:
        s["level"], s["slope"] = x, 0.0
    else:
        level = s["level"] + s["slope"]
        p00 = s["p00"] + s["p10"] + s["p01"] + s["p11"] + c["q_level"]
        p01, p10, p11 = s["p01"] + s["p11"], s["p10"] + s["p11"], s["p11"] + c["q_slope"]
        noise = p00 + c["r_obs"]
        k0, k1, miss = p00 / noise, p10 / noise, x - level
        s.update(level=level + k0 * miss, slope=s["slope"] + k1 * miss, p00=p00 - k0 * p00, p01=p01 - k0 * p01, p10=p10 - k1 * p00, p11=p11 - k1 * p01)
    s["value"] = max(0.0, s["slope"] / math.sqrt(max(s["p11"], 1e-12)))
