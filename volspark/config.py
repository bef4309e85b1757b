"""Parameters of the iterative algorithms, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class OperatorParams:
    """L = -alpha laplacian - beta grad div + gamma, to a power."""

    alpha: float = 0.01
    beta: float = 0.01
    gamma: float = 0.001
    power: float = 1.0
    incompressible: bool = False


@dataclass(frozen=True)
class Level:
    """A level of a pyramid: images with every ``factor``-th voxel, and so many iterations there (those of the method if None)."""

    factor: int = 1
    iterations: int | None = None


#: The finest level alone.
FULL = (Level(),)


@dataclass(frozen=True)
class GreedyParams:
    iterations: int = 50
    max_pert: float = 0.1
    operator: OperatorParams = field(default_factory=OperatorParams)


@dataclass(frozen=True)
class LDMMParams:
    """``reparameterise`` is a number of iterations after which velocities get constant speed; 0 for never."""

    iterations: int = 50
    time_steps: int = 5
    sigma: float = 5.0
    step: float = 0.005
    adaptive: bool = True
    max_pert: float = 0.1
    auto_reduce: bool = False
    reparameterise: int = 0
    operator: OperatorParams = field(default_factory=OperatorParams)


@dataclass(frozen=True)
class AtlasParams:
    """How the images of a cohort are averaged.

    ``median`` weighs by the inverse distance to the last mean, ``trimmed_size``
    takes so many closest images only (0 for all), ``voxel_median`` takes the
    lower median of each voxel. ``jacobian_scale`` holds where deformations go
    from the mean to the images.
    """

    median: bool = False
    trimmed_size: int = 0
    voxel_median: bool = False
    jacobian_scale: bool = True
    scale_weights: bool = True


@dataclass(frozen=True)
class PreprocessParams:
    """Intensity window, border taper and blur of an image before it is used."""

    out_low: float = 0.0
    out_high: float = 1.0
    window: tuple[float, float] | None = None
    tukey_width: int = 5
    blur_sigma: float = 0.0
