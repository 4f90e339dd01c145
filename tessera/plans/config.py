"""Options of the two pipelines, with their defaults and ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import TypeVar

from tessera.functions.planes import SPACES

Config = TypeVar("Config", "FuseConfig", "BlendConfig")


class Parameters(dict):
    """Expert key=value options as text, read by type with a default."""

    @classmethod
    def parse(cls, text: str) -> Parameters:
        return cls(p.split("=", 1) if "=" in p else (p, "1") for p in text.split(":") if p)

    def integer(self, key: str, default: int) -> int:
        return int(self.get(key, default))

    def real(self, key: str, default: float) -> float:
        return float(self.get(key, default))

    def flag(self, key: str, default: bool) -> bool:
        value = str(self.get(key, default)).lower()
        if value not in ("1", "0", "true", "false", "yes", "no"):
            raise ValueError(f"{key} is neither true nor false: {value!r}")
        return value in ("1", "true", "yes")


def override(config: Config, parameters: Parameters) -> Config:
    """``config`` with the named options changed; a name that is no option is an error."""
    kinds = {f.name: type(getattr(config, f.name)) for f in fields(config)}
    changed = {}
    for key in parameters:
        name = key.replace("-", "_")
        if name not in kinds or kinds[name] is tuple:
            raise ValueError(f"unknown parameter {key!r}")
        changed[name] = {bool: parameters.flag, int: parameters.integer, float: parameters.real}.get(kinds[name], parameters.get)(key, getattr(config, name))
    return replace(config, **changed)


@dataclass(frozen=True)
class FuseConfig:
    """Stack fusion: criterion weights in [0, 1] and their shapes.

    With ``lce_scale`` the image is sharpened by a Gaussian of that scale, ``lce_factor`` strong, before its edges are sought. Values
    at or under ``entropy_lower`` of the range count as 0 in the entropy, those from ``entropy_upper`` on as the largest.
    Exposure counts only where ``lower_projector`` reaches ``exposure_lower`` and ``upper_projector`` does not
    pass ``exposure_upper`` (shares of the range). Contrast is the local deviation or, with an
    ``edge_scale``, the Laplacian of a Gaussian of that scale, for which the deviation
    stands in where it is under ``min_curvature``.
    """

    exposure_weight: float = 1.0
    contrast_weight: float = 0.0
    saturation_weight: float = 0.0
    entropy_weight: float = 0.0
    exposure_optimum: float = 0.5
    exposure_width: float = 0.2
    exposure_function: str = "gaussian"
    projector: str = "average"
    exposure_lower: float = 0.0
    exposure_upper: float = 1.0
    lower_projector: str = "anti-value"
    upper_projector: str = "value"
    contrast_window: int = 5
    edge_scale: float = 0.0
    min_curvature: float = 0.0
    lce_scale: float = 0.0
    lce_factor: float = 0.0
    entropy_lower: float = 0.0
    entropy_upper: float = 1.0
    entropy_window: int = 3
    hard_mask: bool = False
    levels: int = 0

    def __post_init__(self) -> None:
        for name in ("exposure_weight", "contrast_weight", "saturation_weight", "entropy_weight", "exposure_optimum", "exposure_lower", "exposure_upper", "entropy_lower", "entropy_upper"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be from 0 to 1")
        if self.exposure_width <= 0:
            raise ValueError("exposure_width must be positive")
        if min(self.edge_scale, self.min_curvature, self.lce_scale, self.lce_factor) < 0:
            raise ValueError("edge_scale, min_curvature, lce_scale and lce_factor must not be negative")
        if self.entropy_lower >= self.entropy_upper:
            raise ValueError("entropy_lower must be under entropy_upper")
        if not any((self.exposure_weight, self.contrast_weight, self.saturation_weight, self.entropy_weight)):
            raise ValueError("at least one criterion needs a weight")
        if self.contrast_window < 3 or self.contrast_window % 2 == 0 or self.entropy_window < 3 or self.entropy_window % 2 == 0:
            raise ValueError("windows must be odd and at least 3")


@dataclass(frozen=True)
class BlendConfig:
    """Mosaic blending: blending space, seam generation and optimisation.

    Colour images of 8 bits blend in their channels or in the planes of a perceptual ``space``.
    A seam is the nearest-feature mask or a graph cut along it, found on every ``coarse_factor``-th
    row and column; its contours, a vertex every ``vectorize_distance`` corners (0: as many as suit the mask), go through the optimizers.
    Where that leaves the smallest image fewer than ``smallest_coarse`` places, masks are fine instead, see :meth:`for_images`.
    """

    levels: int = 0
    wrap: str = "none"
    space: str = "identity"
    seam: str = "graphcut"
    coarse_factor: int = 8
    smallest_coarse: int = 64
    vectorize_distance: int = 0
    optimizers: tuple[str, ...] = ("anneal", "dijkstra")
    difference: str = "delta-e"
    luminance_weight: float = 1.0
    chrominance_weight: float = 1.0
    distance_weight: float = 12.0
    mismatch_weight: float = 1.0
    tau: float = 0.75
    delta_max: float = 7000.0
    delta_min: float = 5.0
    k_max: int = 32
    dijkstra_radius: int = 25
    pre_assemble: bool = False

    def __post_init__(self) -> None:
        if self.wrap not in ("none", "horizontal", "vertical", "both"):
            raise ValueError("wrap must be none, horizontal, vertical or both")
        if self.space not in SPACES:
            raise ValueError(f"space must be one of {', '.join(SPACES)}")
        if self.seam not in ("nearest", "graphcut"):
            raise ValueError("seam must be nearest or graphcut")
        if not set(self.optimizers) <= {"anneal", "dijkstra"}:
            raise ValueError("optimizers are anneal and dijkstra")
        if not 0 < self.tau < 1 or self.k_max < 3 or self.dijkstra_radius < 1:
            raise ValueError("annealing needs 0 < tau < 1, k_max >= 3 and a positive radius")
        if self.coarse_factor < 1 or self.vectorize_distance < 0:
            raise ValueError("coarse_factor must be at least 1, vectorize_distance not negative")
        if self.difference not in ("delta-e", "hue-luminance"):
            raise ValueError("difference must be delta-e or hue-luminance")
        if min(self.luminance_weight, self.chrominance_weight) < 0 or not self.luminance_weight + self.chrominance_weight:
            raise ValueError("difference weights must not be negative, nor both zero")

    def for_images(self, shortest: int) -> BlendConfig:
        """The options in force where the shortest side of an image is ``shortest``.

        A coarse mask that would be too small gives way to a fine one, and a graph cut of that is not optimised further; vertices
        are 4 corners apart on coarse masks, 20 on fine ones.
        """
        config = self
        if config.coarse_factor > 1 and shortest // config.coarse_factor < config.smallest_coarse:
            config = replace(config, coarse_factor=1, optimizers=() if config.seam == "graphcut" else config.optimizers)
        return config if config.vectorize_distance else replace(config, vectorize_distance=4 if config.coarse_factor > 1 else 20)


#: Seams as they come from the distance transforms.
NEAREST = BlendConfig(seam="nearest", optimizers=())
