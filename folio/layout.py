"""Glyphs of a page to reading-order text and to words: one pass, since each glyph is held against the run before it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from .kernel.content import Glyph

#: Fixed thresholds, in sizes of the text: off the line, gap back, gap ahead, a space; between lines.
_OFF, _BACK, _AHEAD, _SPACE, _LINE = 0.3, -0.6, 3.0, 0.15, 0.5


class _Run:
    """Glyphs of one line so far: where it starts and ends, which way it goes."""

    def __init__(self, g: Glyph, way: tuple[float, float], seq: int):
        self.ox, self.oy, self.ex, self.ey = g.x0, g.y0, g.x1, g.y1
        self.way, self.size, self.seq, self.glyphs, self.text = way, g.size or 1.0, seq, [g], [g.text]

    def gap(self, g: Glyph, way: tuple[float, float]) -> float | None:
        """How far ahead of the end the glyph starts, or None if it isn't on the line."""
        size = max(g.size if g.size > 0 else 1.0, self.size)
        if way[0] * self.way[0] + way[1] * self.way[1] <= 0.95:
            return None
        if abs((g.x0 - self.ox) * -self.way[1] + (g.y0 - self.oy) * self.way[0]) > _OFF * size:
            return None
        ahead = (g.x0 - self.ex) * self.way[0] + (g.y0 - self.ey) * self.way[1]
        return ahead if _BACK * size < ahead < _AHEAD * size else None


def _way(g: Glyph, before: _Run | None) -> tuple[float, float]:
    dx, dy = g.x1 - g.x0, g.y1 - g.y0
    n = math.hypot(dx, dy)
    return (dx / n, dy / n) if n > 0 else before.way if before else (1.0, 0.0)


def reading_text(glyphs: Sequence[Glyph]) -> str:
    """Runs sorted into lines from top to bottom and left to right."""
    runs: list[_Run] = []
    for i, g in enumerate(glyphs):
        last = runs[-1] if runs else None
        way = _way(g, last)
        ahead = last.gap(g, way) if last else None
        if ahead is None:
            new = _Run(g, way, i)
            new.size = g.size if g.size > 0 else 1.0
            runs.append(new)
            continue
        size = max(g.size if g.size > 0 else 1.0, last.size)
        if ahead > _SPACE * size and not g.text.startswith(" ") and not last.text[-1].endswith(" "):
            last.text.append(" ")
        last.text.append(g.text)
        if (g.x1 - last.ex) * last.way[0] + (g.y1 - last.ey) * last.way[1] > 0:
            last.ex, last.ey = g.x1, g.y1
        last.size = size
    runs.sort(key=lambda r: (-r.oy, r.ox, r.seq))
    lines: list[list[_Run]] = []
    for r in runs:
        if lines and lines[-1][0].oy - r.oy <= _LINE * max(lines[-1][0].size, r.size):
            lines[-1].append(r)
        else:
            lines.append([r])
    out = []
    for line in lines:
        text = ""
        for r in sorted(line, key=lambda r: (r.ox, r.seq)):
            part = "".join(r.text)
            text += (" " if text and not text.endswith(" ") and not part.startswith(" ") else "") + part
        out.append(text)
    return "\n".join(out).rstrip(" \n")


def words(glyphs: Sequence[Glyph], top: float) -> list[dict]:
    """Runs without blanks as integer boxes: width, height, x, y from the top of the media box, whether a blank follows, text, font."""
    done: list[tuple[float, float, dict]] = []
    run: _Run | None = None

    def flush(space: bool) -> None:
        nonlocal run
        if run is None:
            return
        xs, ys = [], []
        for g in run.glyphs:
            ux, uy = -run.way[1] * g.size, run.way[0] * g.size
            for x, y in ((g.x0, g.y0), (g.x1, g.y1)):
                for e in (g.ascent, g.descent):
                    xs.append(x + ux * e)
                    ys.append(y + uy * e)
        left, right, low, high = min(xs), max(xs), min(ys), max(ys)
        whole = lambda v: int(round(v))
        done.append((-round(run.oy), run.ox, {"width": whole(right - left), "height": whole(high - low), "x": whole(left), "y": whole(top - high), "space": space, "text": "".join(g.text for g in run.glyphs), "font_name": run.glyphs[0].font, "font_size": max(g.size for g in run.glyphs)}))
        run = None

    for i, g in enumerate(glyphs):
        if not all(map(math.isfinite, g[:5])):
            continue
        blank = not g.text.strip()
        way = _way(g, run)
        if run is not None:
            size = max(g.size if g.size > 0 else 1.0, run.size)
            ahead = run.gap(g, way)
            if ahead is None:
                flush(False)
            elif blank or ahead > _SPACE * size:
                flush(True)
        if blank:
            continue
        if run is None:
            run = _Run(g, way, i)
            run.size = g.size if g.size > 0 else 1.0
        else:
            run.glyphs.append(g)
            run.ex, run.ey, run.size = g.x1, g.y1, max(run.size, g.size)
    flush(False)
    done.sort(key=lambda w: w[:2])
    return [w[2] for w in done]
