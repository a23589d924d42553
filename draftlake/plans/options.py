"""Options. Numbers of zero or less mean the default."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class WallOptions:
    min_thickness: float = 0.03  # metres, as all lengths here
    max_thickness: float = 0.60
    min_wall_length: float = 0.30
    angle_tolerance: float = 5.0  # degrees
    merge_gap: float = 0.05
    bridge_gap: float = 1.20
    most_instances: float = 50e6  # of blocks in a drawing; one with more is rejected before it is expanded
    include_curves: bool = False
    scale: float = 0.01
    dpi: float = 300.0
    layers: tuple[str, ...] = ()  # exact names; none: all
    wall_layers: tuple[str, ...] = ()
    exclude_layers: tuple[str, ...] = ()
    no_default_blacklist: bool = False

    def __post_init__(self):
        for f in fields(self):
            if isinstance(f.default, float) and getattr(self, f.name) <= 0:
                object.__setattr__(self, f.name, f.default)


@dataclass(frozen=True)
class SheetOptions:
    paper: str = "A4"
    scale: str = "1:100"
    margin: float = 10.0  # millimetres; negative: the default
    align: str = "center"
    auto_paper: bool = False
    tile: bool = False

    def __post_init__(self):
        if self.margin < 0:
            object.__setattr__(self, "margin", 10.0)
