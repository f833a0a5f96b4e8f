"""Small state machines over one session's readings: state in, reading in, state and rows out."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Machine:
    """step(state, reading) changes the state, a dict of plain values, and yields rows of the schema after the key."""

    start: Callable[[], dict[str, Any]]
    step: Callable[[dict[str, Any], Any], Iterator[tuple]]
    schema: str
    columns: tuple[str, ...] = field(default=("t",))


def step_detector(fast: float = 0.25, slow: float = 0.02, threshold: float = 0.6, reset: float = 0.0, gap: int = 250_000_000, echo: int = 350_000_000, window: int = 200_000_000, drop: float = 0.8, upright: bool = False) -> Machine:
    """Steps in a magnitude signal (t in ns, value; with upright a column of that name: whether the device hangs upright, as in a pocket).

    swing is how far a quick average of the signal stands above a slow one. A swing begins where it passes the threshold and ends below
    reset; it is a step unless it begins too soon after the last step: within gap, or within echo while upright, where one
    foot fall shows twice. The step is told once its peak is known: when the swing has fallen off it, or after the window.
    """

    def start() -> dict[str, Any]:
        return {"quick": None, "base": None, "swinging": False, "last": None, "peak": None}

    def told(s: dict[str, Any]) -> tuple:
        out = (s["last"], s["peak"])
        s["peak"] = None
        return out

    def step(s: dict[str, Any], r: Any) -> Iterator[tuple]:
        if s["quick"] is None:
            s["quick"] = s["base"] = 9.81
        s["quick"], s["base"] = s["quick"] + fast * (r.value - s["quick"]), s["base"] + slow * (r.value - s["base"])
        swing, since = s["quick"] - s["base"], math.inf if s["last"] is None else r.t - s["last"]
        if s["peak"] is not None:
            s["peak"] = max(s["peak"], swing)
            if since >= window or swing < drop * s["peak"]:
                yield told(s)
        begins = not s["swinging"] and swing > threshold
        if begins and since >= (echo if upright and r.upright else gap):
            if s["peak"] is not None:
                yield told(s)
            s["swinging"], s["last"], s["peak"] = True, int(r.t), swing
        elif s["swinging"] and swing < reset:
            s["swinging"] = False

    return Machine(start, step, "t long, peak double", ("t", "value", "upright") if upright else ("t", "value"))


def position_filter(per_step: float = 0.5, sigmas: float = 3.0, outliers: int = 5, poorest: float = 30.0, area: tuple[float, float] | None = None) -> Machine:
    """Steps and fixes (kind, dx or x, dy or y, accuracy) merged with one variance for the place: fixes far off count, and move it when they persist.

    A fix less accurate than poorest metres, or outside the map (0 to area's width and height), says nothing, not even that it is far off.
    """

    def start() -> dict[str, Any]:
        return {"x": None, "y": None, "var": 0.0, "far": 0, "steps": 0}

    def step(s: dict[str, Any], r: Any) -> Iterator[tuple]:
        said = "step"
        if r.kind == "step":
            if s["x"] is None:
                return
            s["x"], s["y"], s["var"], s["steps"] = s["x"] + r.x, s["y"] + r.y, s["var"] + per_step, s["steps"] + 1
        elif r.accuracy > poorest or (area is not None and not (0 <= r.x <= area[0] and 0 <= r.y <= area[1])):
            if s["x"] is None:
                return
            said = "passed over"
        else:
            var = float(r.accuracy) ** 2
            if s["x"] is None:
                s.update(x=float(r.x), y=float(r.y), var=var)
                said = "start"
            else:
                off = math.hypot(r.x - s["x"], r.y - s["y"])
                if off > sigmas * math.sqrt(s["var"] + var):
                    s["far"] += 1
                    said = "outlier"
                    if s["far"] >= outliers:
                        s.update(x=float(r.x), y=float(r.y), var=var, far=0)
                        said = "jump"
                else:
                    s["far"] = 0
                    said = "still"
                    if s["steps"] or var < s["var"]:
                        k = s["var"] / (s["var"] + var)
                        s["x"], s["y"] = s["x"] + k * (r.x - s["x"]), s["y"] + k * (r.y - s["y"])
                        s["var"], s["steps"], said = s["var"] * (1 - k), 0, "fix"
        yield r.t, s["x"], s["y"], s["var"], said

    return Machine(start, step, "t long, x double, y double, var double, said string", ("t", "kind", "x", "y", "accuracy"))


def heading_runs(within: float = 20.0) -> Machine:
    """Stretches of headings (t, value) that all lie within so many degrees of their first; each is told when the next one begins, and at its end row by row."""

    def start() -> dict[str, Any]:
        return {"run": 0, "first": None, "n": 0}

    def step(s: dict[str, Any], r: Any) -> Iterator[tuple]:
        off = None if s["first"] is None else abs((math.fmod(r.value - s["first"], 360.0) + 540.0) % 360.0 - 180.0)
        if off is None or off > within:
            s.update(run=s["run"] + 1, first=float(r.value), n=0)
        s["n"] += 1
        yield r.t, s["run"], s["n"], s["first"]

    return Machine(start, step, "t long, run long, n long, first double", ("t", "value"))


def tilt_filter(gain: float = 0.02) -> Machine:
    """Roll and pitch in degrees from turn rates (gx, gy in degrees a second) and gravity (ax, ay, az): rates are integrated, gravity pulls slowly."""

    def start() -> dict[str, Any]:
        return {"t": None, "roll": 0.0, "pitch": 0.0}

    def step(s: dict[str, Any], r: Any) -> Iterator[tuple]:
        roll, pitch = math.degrees(math.atan2(r.ay, r.az)), math.degrees(math.atan2(-r.ax, math.hypot(r.ay, r.az)))
        if s["t"] is None:
            s.update(roll=roll, pitch=pitch)
        else:
            dt = (r.t - s["t"]) / 1e9
            for name, rate, seen in (("roll", r.gx, roll), ("pitch", r.gy, pitch)):
                ahead = s[name] + rate * dt
                off = math.fmod(math.fmod(seen - ahead, 360.0) + 540.0, 360.0) - 180.0
                s[name] = ahead + gain * off
        s["t"] = int(r.t)
        yield r.t, s["roll"], s["pitch"]

    return Machine(start, step, "t long, roll double, pitch double", ("t", "gx", "gy", "ax", "ay", "az"))


def _times(a: tuple, b: tuple) -> tuple:
    """The turn b, then the turn a, as quaternions."""
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw


def _turn(angle: float, x: float, y: float, z: float) -> tuple:
    k = math.sin(angle / 2) / max(math.sqrt(x * x + y * y + z * z), 1e-12)
    return math.cos(angle / 2), k * x, k * y, k * z


def orientation(gain: float = 0.02, off: float = 2.0, longest: float = 0.1) -> Machine:
    """How the device lies in the world (east, north, up), told after each reading as a quaternion, its azimuth and tilt in degrees.

    A reading has t in ns, kind and x, y, z: a seed (with w, a quaternion from device to world), turn rates in rad/s around the device's axes, or an
    acceleration in m/s². Rates are integrated, no gap longer than a tenth of a second; an acceleration within 2 m/s² of gravity
    pulls the tilt a little, around a level axis, so the azimuth stays. What comes before a seed and readings with nulls say nothing.
    """

    def step(s: dict[str, Any], r: Any) -> Iterator[tuple]:
        v = [None if k is None or k != k else float(k) for k in (r.x, r.y, r.z)]
        if None in v or (s["q"] is None and r.kind != "seed"):
            return
        x, y, z = v
        if r.kind == "seed":
            norm = math.sqrt(r.w * r.w + x * x + y * y + z * z) or 1.0
            s.update(q=[r.w / norm, x / norm, y / norm, z / norm], t=None)
        elif r.kind == "rate":
            if s["t"] is not None:
                angle = math.sqrt(x * x + y * y + z * z) * min(max((r.t - s["t"]) / 1e9, 0.0), longest)
                s["q"] = _times(tuple(s["q"]), _turn(angle, x, y, z))
            s["t"] = int(r.t)
        else:
            size = math.sqrt(x * x + y * y + z * z)
            if abs(size - 9.81) <= off:
                w, a, b, c = s["q"]
                _, ux, uy, uz = _times(_times((w, a, b, c), (0.0, x, y, z)), (w, -a, -b, -c))
                level = math.hypot(ux, uy)
                if level > 1e-9 * size:
                    s["q"] = _times(_turn(gain * math.atan2(level, uz), uy, -ux, 0.0), (w, a, b, c))
        norm = math.sqrt(sum(k * k for k in s["q"]))
        s["q"] = w, a, b, c = [k / norm for k in s["q"]]
        yield r.t, w, a, b, c, math.degrees(math.atan2(2 * (a * b - w * c), 1 - 2 * (a * a + c * c))), math.degrees(math.acos(max(-1.0, min(1.0, 1 - 2 * (a * a + b * b)))))

    return Machine(lambda: {"q": None, "t": None}, step, "t long, w double, x double, y double, z double, azimuth double, tilt double", ("t", "kind", "w", "x", "y", "z"))


def step_gate(needed: int = 4, pause: int = 1_500_000_000) -> Machine:
    """Holds steps (t) back until so many follow each other without a pause, then lets them all go; a shorter burst is handling and is dropped."""

    def step(s: dict[str, Any], r: Any) -> Iterator[tuple]:
        if s["last"] is not None and r.t - s["last"] >= pause:
            s.update(held=[], open=False)
        s["last"] = int(r.t)
        if s["open"]:
            yield r.t, False
            return
        s["held"].append(int(r.t))
        if len(s["held"]) >= needed:
            for t in s["held"]:
                yield t, t != r.t
            s.update(held=[], open=True)

    return Machine(lambda: {"last": None, "held": [], "open": False}, step, "t long, late boolean", ("t",))


def _off(a: float, b: float) -> float:
    return (a - b + 540.0) % 360.0 - 180.0


def walking_direction(turn: float = 30.0, match: float = 20.0, steady: float = 20.0, gain: float = 0.3, big: float = 45.0, longest: int = 6, pause: int = 2_500_000_000, rhythm: int = 400_000_000) -> Machine:
    """Which way each step goes: seq, revision and heading; a later revision of a step takes the place of an earlier one, six steps back at most.

    A step has t in ns, seq, phone (the device's heading), phase (the walking direction that acceleration over the last two steps shows, null
    where it is weak), stairs (true near stairs, where phase doesn't hold), pose (a number for as long as the device is held alike, null
    while it is moved) and level (true for a new pose held out in front after a pocket).

    The heading is the phone's plus what it is held off by, which phase corrects: a little at once, or wholly when two phases in a row say
    so; then the steps walked that way already are told again. While the device is moved the heading stays what it was, and a new pose is
    taken to go on so. A quick turn of the phone counts as the walker's until the phone is steady for three steps: if phase then
    shows the old way, only the phone was turned, and the steps of the turn are told again.
    """

    def start() -> dict[str, Any]:
        # recent: the last steps as [seq, revision, t, phone, phase it was told with, in a turn, after a pause]
        return {"off": 0.0, "pose": None, "held": None, "moving": False, "recent": [], "calm": None, "way": 0.0, "trusted": False, "phase": None, "turn": None}

    def told(s: dict[str, Any], heading: float, redo: int) -> Iterator[tuple]:
        heading %= 360.0
        for step in s["recent"][len(s["recent"]) - 1 - redo : len(s["recent"]) - 1]:
            step[1] += 1
            yield step[0], step[1], heading
        yield s["recent"][-1][0], 0, heading

    def is_steady(s: dict[str, Any]) -> bool:
        last = s["recent"][-3:]
        return len(last) == 3 and all(abs(_off(x[3], last[0][3])) <= steady for x in last)

    def walked_so(s: dict[str, Any], way: float) -> int:
        n = 0
        for x in reversed(s["recent"][:-1]):
            if n == longest or x[5] or (x[4] is not None and abs(_off(x[4], way)) > match):
                break
            n += 1
            if x[6]:
                break
        return n

    def forget(s: dict[str, Any]) -> None:
        s.update(recent=[], calm=None, trusted=False, phase=None, turn=None)

    def step(s: dict[str, Any], r: Any) -> Iterator[tuple]:
        phase = None if r.phase is None or math.isnan(r.phase) or r.stairs else float(r.phase)
        pose = None if r.pose is None or math.isnan(r.pose) else int(r.pose)
        if pose is None:  # moved: as before
            if not s["moving"]:
                s.update(moving=True, held=s["way"] if s["calm"] is not None else float(r.phone) + s["off"])
                forget(s)
            yield int(r.seq), 0, s["held"] % 360.0
            return
        if s["moving"] or (s["pose"] is not None and pose != s["pose"]):
            held = s["held"] if s["moving"] else s["way"]
            s.update(off=0.0 if r.level else _off(held, r.phone), moving=False)
            forget(s)
        s["pose"] = pose
        after = not s["recent"] or r.t - s["recent"][-1][2] > pause
        s["recent"] = [*s["recent"][-longest:], [int(r.seq), 0, int(r.t), float(r.phone), None, False, after]]
        here, phone = s["recent"][-1], float(r.phone)
        if s["turn"] is None and s["calm"] is not None and abs(_off(phone, s["calm"])) > turn:
            s.update(turn={"phone": s["calm"], "way": s["way"], "trusted": s["trusted"], "n": 0, "most": 0.0}, phase=None)
        t, redo = s["turn"], 0
        if t is not None:
            here[5] = True
            t["n"] += 1
            t["most"] = max(t["most"], abs(_off(phone, t["phone"])))
            settled = is_steady(s)
            if not settled and t["n"] < longest:
                yield from told(s, phone + s["off"], 0)
                return
            way = phase if settled and t["most"] >= turn else None
            s.update(turn=None, phase=way)
            if way is not None and t["trusted"] and abs(_off(way, t["way"])) <= match:
                s["off"], redo = _off(t["way"], phone), t["n"] - 1  # the phone alone
            elif way is not None and abs(_off(way, phone + s["off"])) > big and all(b[2] - a[2] >= rhythm for a, b in zip(s["recent"][-3:], s["recent"][-2:], strict=False)):
                s["off"] = _off(way, phone)
        elif r.stairs:
            s["phase"] = None
        elif phase is not None and is_steady(s):
            before, s["phase"], here[4] = s["phase"], phase, phase
            off = _off(phase, phone + s["off"])
            s["trusted"] = abs(off) <= match
            if abs(off) <= big:
                s["off"] = _off(s["off"] + gain * off, 0.0)
            elif before is not None and abs(_off(phase, before)) <= match:
                s["off"], redo = _off(phase, phone), walked_so(s, phase)
        s.update(calm=phone, way=phone + s["off"])
        yield from told(s, s["way"], min(redo, len(s["recent"]) - 1))

    return Machine(start, step, "seq long, revision int, heading double", ("t", "seq", "phone", "phase", "stairs", "pose", "level"))
