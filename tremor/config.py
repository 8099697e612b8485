"""Parameters of the vibration jobs, and the fixed names of classes."""

from __future__ import annotations

from dataclasses import dataclass

# The classes in their order, and the names that stand for them.
CLASSES = ("healthy", "imbalanced", "obstruction")
ALIASES = {
    "healthy": "healthy",
    "normal": "healthy",
    "good": "healthy",
    "imbalance": "imbalanced",
    "imbalanced": "imbalanced",
    "imabalanced": "imbalanced",
    "obstruction": "obstruction",
    "clogged": "obstruction",
    "blocked": "obstruction",
}

#: Columns of a sample beside stream_id and seq.
AXES = ("accX_raw", "accY_raw", "accZ_raw", "accZ_filt")
VALUES = ("timestamp_ms", *AXES)


@dataclass(frozen=True)
class Sampling:
    """What a recording should look like; defaults for 500 Hz recordings."""

    rate_hz: float = 500.0
    expected_dt_ms: float = 2.0
    min_dt_ms: float = 1.0
    max_dt_ms: float = 3.0
    gap_ms: float = 12.0
    rate_warn: float = 0.05
    rate_fail: float = 0.10
    jitter_fail: float = 0.20
    extreme: float = 1000.0
    segment_gap_ms: float = 5.0
    min_segment: int = 1000
    window: int = 512
    hop: int = 256


#: Frequency bands in Hz: name, low, high. The last one includes its upper end.
BANDS = (("low", 50.0, 80.0), ("mid", 110.0, 140.0), ("high", 170.0, 210.0))
DEFAULT = Sampling()
