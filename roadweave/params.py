"""Defaults of the operators. Distances in metres, times in seconds, image sizes in pixels."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class TrackParams:
    min_life_frames: int = 15
    min_rows: int = 8
    max_gap_frames: int = 30
    smooth_rows: int = 9


@dataclass(frozen=True)
class MotionParams:
    velocity_window_s: float = 0.47
    acceleration_window_s: float = 0.87
    min_heading_speed: float = 1.0
    max_speed: float = 55.0
    max_acceleration: float = 10.0
    max_interpolated: float = 0.5
    moving_speed: float = 0.7
    path_interval_s: float = 0.5
    parked_window_s: float = 10.0
    parked_min_life_s: float = 3.0
    parked_moving_share: float = 0.05
    parked_net_m: float = 2.5
    parked_window_m: float = 3.0

    def half_velocity(self, fps: float) -> int:
        return max(1, round(self.velocity_window_s * fps / 2))

    def half_acceleration(self, fps: float) -> int:
        return max(1, round(self.acceleration_window_s * fps / 2))


@dataclass(frozen=True)
class FlowParams:
    max_offset_m: float = 12.0
    lane_width_m: float = 3.2
    segment_m: float = 50.0
    interval_s: float = 20.0
    congested_kmh: float = 15.0


@dataclass(frozen=True)
class Params:
    track: TrackParams = field(default_factory=TrackParams)
    motion: MotionParams = field(default_factory=MotionParams)
    flow: FlowParams = field(default_factory=FlowParams)

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)


#: The seven modes, what each detector label counts as, and passenger-car equivalents.
MODES = ("pedestrian", "motorcycle", "car", "LGV", "truck", "HGV", "bus")
LABEL_MODES = {
    "pedestrian": "pedestrian",
    "people": "pedestrian",
    "bicycle": "motorcycle",
    "motor": "motorcycle",
    "tricycle": "motorcycle",
    "awning-tricycle": "motorcycle",
    "car": "car",
    "van": "LGV",
    "truck": "truck",
    "bus": "bus",
}
PCE = {"pedestrian": 0.0, "motorcycle": 0.35, "car": 1.0, "LGV": 1.4, "truck": 2.2, "HGV": 3.7, "bus": 3.0}
