"""Display attributes as columns: magnitude and depth classes, colours, sizes, fades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c, clamp, js_round

# Magnitude classes (upper bound exclusive), label, rgb 0-1 and hex.
MAGNITUDE_CLASSES = [
    (2.0, "Micro", (0.31, 0.76, 0.97), "#4fc3f7"),
    (4.0, "Minor", (0.51, 0.78, 0.52), "#81c784"),
    (5.0, "Light", (1.00, 0.95, 0.46), "#fff176"),
    (6.0, "Moderate", (1.00, 0.72, 0.30), "#ffb74d"),
    (7.0, "Strong", (1.00, 0.44, 0.26), "#ff7043"),
    (None, "Major", (0.90, 0.22, 0.21), "#e53935"),
]

# Depth classes (upper bound exclusive, km).
DEPTH_CLASSES = [(70.0, "Shallow"), (300.0, "Intermediate"), (None, "Deep")]

# Heat ramp stops (blue, cyan, yellow, orange, red) and limits.
HEAT_STOPS = [
    (0.10, 0.20, 0.80),
    (0.10, 0.75, 0.80),
    (0.95, 0.90, 0.10),
    (0.95, 0.50, 0.05),
    (0.90, 0.10, 0.05),
]
HEAT_MIN_PROB = 0.01
HEAT_MAX_ALPHA = 0.72


def _stepped(value: Column, classes, pick) -> Column:
    expr = None
    for bound, *rest in classes:
        out = pick(rest)
        if bound is None:
            expr = expr.otherwise(out) if expr is not None else out
        else:
            cond = value < F.lit(bound)
            expr = F.when(cond, out) if expr is None else expr.when(cond, out)
    return F.when(value.isNull(), F.lit(None)).otherwise(expr)


def magnitude_band(mag) -> Column:
    return _stepped(_c(mag).cast("double"), MAGNITUDE_CLASSES, lambda r: F.lit(r[0]))


def magnitude_hex(mag) -> Column:
    return _stepped(_c(mag).cast("double"), MAGNITUDE_CLASSES, lambda r: F.lit(r[2]))


def magnitude_rgb(mag) -> Column:
    m = _c(mag).cast("double")
    return F.struct(*[
        _stepped(m, MAGNITUDE_CLASSES, lambda r, i=i: F.lit(r[1][i])).alias(ch)
        for i, ch in enumerate("rgb")
    ])


def depth_band(depth_km) -> Column:
    d = F.coalesce(_c(depth_km).cast("double"), F.lit(0.0))
    return _stepped(d, DEPTH_CLASSES, lambda r: F.lit(r[0]))


def depth_rgb(depth_km) -> Column:
    """Depth ramp: clamp to 0..700 (null as 0), red->orange to 70, ->yellow-green to 300, ->violet."""
    d = F.greatest(F.lit(0.0), F.least(F.lit(700.0), F.coalesce(_c(depth_km).cast("double"), F.lit(0.0))))
    t1 = d / F.lit(70.0)
    t2 = (d - F.lit(70.0)) / F.lit(230.0)
    t3 = (d - F.lit(300.0)) / F.lit(400.0)

    def piece(a, b, c):
        return F.when(d < 70, a).when(d < 300, b).otherwise(c)

    r = piece(F.lit(1.0), F.lit(1.0) - t2 * 0.65, F.lit(0.35) - t3 * 0.25)
    g = piece(F.lit(0.25) + t1 * 0.35, F.lit(0.60) - t2 * 0.15, F.lit(0.45) - t3 * 0.15)
    b = piece(F.lit(0.05), F.lit(0.05) + t2 * 0.30, F.lit(0.35) + t3 * 0.65)
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def point_size(mag) -> Column:
    m = _c(mag).cast("double")
    return F.when(m.isNull(), None).otherwise(F.greatest(F.lit(1.0), (m - F.lit(2.0)) * F.lit(1.2)))


def mag_radius(mag) -> Column:
    m = _c(mag).cast("double")
    return F.when(m.isNull(), None).otherwise(F.greatest(F.lit(2.0), F.lit(1.8) * F.pow(F.lit(2.0), m - F.lit(1.0))))


def tick_height(mag) -> Column:
    """Timeline tick height ``clamp(2 * radius, 4, 38)``."""
    return clamp(mag_radius(mag) * F.lit(2.0), 4.0, 38.0)


def window_age(time_ms, start_ms: int, end_ms: int) -> Column:
    """Position in the window, 0 at its start and 1 at its leading edge."""
    span = float(end_ms - start_ms)
    return clamp((_c(time_ms).cast("double") - F.lit(float(start_ms))) / F.lit(span), 0.0, 1.0)


def age_fade(age) -> Column:
    return F.pow(_c(age), F.lit(6.0))


def heat_rgb(p, min_prob: float = HEAT_MIN_PROB) -> Column:
    """Five-stop heat colour; null (not drawn) at or below ``min_prob``."""
    prob = _c(p).cast("double")
    t = clamp((prob - F.lit(min_prob)) / F.lit(1.0 - min_prob), 0.0, 1.0)

    def mix(i, seg_t):
        lo, hi = HEAT_STOPS[i], HEAT_STOPS[i + 1]
        return [F.lit(lo[k]) + (F.lit(hi[k]) - F.lit(lo[k])) * seg_t for k in range(3)]

    segs = [mix(0, t / 0.25), mix(1, (t - 0.25) / 0.25), mix(2, (t - 0.5) / 0.25), mix(3, (t - 0.75) / 0.25)]
    chans = []
    for k, ch in enumerate("rgb"):
        v = F.when(t < 0.25, segs[0][k]).when(t < 0.5, segs[1][k]).when(t < 0.75, segs[2][k]).otherwise(segs[3][k])
        chans.append(v.alias(ch))
    return F.when(prob.isNull() | (prob <= F.lit(min_prob)), F.lit(None)).otherwise(F.struct(*chans))


def heat_alpha(p) -> Column:
    return clamp(_c(p).cast("double") * F.lit(2.5), 0.0, HEAT_MAX_ALPHA)


def depth_bar(depth_km, canvas_height: float) -> Column:
    """Bar height on the regional map, only for depth > 0: taller means shallower."""
    d = _c(depth_km).cast("double")
    h = F.least(F.lit(0.12 * canvas_height), (F.lit(1.0) - F.least(d, F.lit(300.0)) / F.lit(300.0)) * F.lit(60.0) + F.lit(4.0))
    return F.when(d > 0, h).otherwise(F.lit(None))


def rgb_css(rgb) -> Column:
    """``rgb(R,G,B)`` with ``Math.round(255 * c)``."""
    s = _c(rgb)
    parts = [js_round(s[ch] * F.lit(255.0)).cast("string") for ch in "rgb"]
    return F.concat(F.lit("rgb("), parts[0], F.lit(","), parts[1], F.lit(","), parts[2], F.lit(")"))


# Timeline views (start of the "all" and "1990" views, Unix ms).
VIEW_ALL_START_MS = -2_208_988_800_000   # 1900-01-01T00:00Z
VIEW_1990_START_MS = 631_152_000_000     # 1990-01-01T00:00Z


def view_bounds(mode: str, data_end_ms: int, year_ms: int = 31_557_600_000) -> tuple[int, int]:
    """``(view_start, view_length)`` of the timeline: all (1900), 1990, or the recent year."""
    start = {"all": VIEW_ALL_START_MS, "1990": VIEW_1990_START_MS, "recent": data_end_ms - year_ms}[mode]
    return start, data_end_ms - start


def view_progress(window_start, view_start_ms: int, view_length_ms: int) -> Column:
    """Playhead position on the timeline bar: ``clamp((start - view_start) / view_length, 0, 1)``."""
    x = (_c(window_start).cast("double") - F.lit(float(view_start_ms))) / F.lit(float(view_length_ms))
    return clamp(x, 0.0, 1.0)
