"""Thresholds of the part analytics, all in one place. They must equal the published behaviour."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    mm_per_inch: float = 25.4
    lb_per_in3: float = 0.0361273  # of one g/cm3
    contiguity: float = 1e-6  # inches between neighbours
    thin_wall_warning: float = 0.001
    length_gate: tuple[float, float] = (0.8, 2.0)
    od_gate: tuple[float, float] = (1.0, 3.0)
    step_overall: float = 0.75  # below: review
    step_segment: float = 0.5
    step_thin_walls: int = 1
    low_confidence: float = 0.6
    thin_wall: float = 0.05
    short_share: float = 0.02
    snap: tuple[float, float] = (0.02, 0.005)  # at least, share of the range
    short: tuple[float, float] = (0.005, 0.002)
    similar: tuple[float, float] = (0.02, 0.01)  # at least, share of the mean diameter
    rm_od_allowance: float = 0.10
    rm_len_allowance: float = 0.35
    rm_od_step: float = 0.05
    rm_len_step: float = 0.10
    anchor_ranges: tuple[tuple[float, float], ...] = ((1.245, 1.255), (1.654, 1.660))
    view_conf: float = 0.65
    ocr_conf: float = 0.5


DEFAULT = Params()
