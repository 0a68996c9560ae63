"""Typed run settings, the key of a feature table, and sweeps over settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

from patchlight.functions.vectors import NORM_OFFSET
from patchlight.layout import Shape
from patchlight.operators.convolve import Layer
from patchlight.solvers.whitening import EPSILON, Whitener


@dataclass(frozen=True)
class FeatureConf:
    """What decides the feature values; one entry per layer in the tuples."""

    dataset: str = ""
    width: int = 8
    height: int = 8
    channels: int = 1
    seed: int = 0
    patch_sizes: tuple[int, ...] = (5,)
    filters: tuple[int, ...] = (50,)
    bandwidth: tuple[float, ...] = (1.8,)
    conv_stride: tuple[int, ...] = (1,)
    pool: tuple[int, ...] = (2,)
    pool_stride: tuple[int, ...] = (2,)
    pool_kind: str = "mean"
    zero_pad: tuple[int, ...] = ()
    fastfood: tuple[int, ...] = ()
    float_layers: tuple[int, ...] = ()
    rescale: bool = False
    norm: str = "offset"
    nonlinearity: str = "cos"
    alpha: float = 0.0
    whiten: bool | tuple[bool, ...] = False
    whitener_epsilon: float = EPSILON
    norm_offset: float = NORM_OFFSET
    whitener_sample: int | None = None

    def __post_init__(self) -> None:
        if isinstance(self.whiten, tuple) and any(self.whiten[1:]):
            raise ValueError("only the first layer can be whitened")

    @property
    def whitens(self) -> bool:
        """Whether the first layer is whitened; ``whiten`` is one flag or one for each layer."""
        return any(self.whiten) if isinstance(self.whiten, tuple) else bool(self.whiten)

    @property
    def layers(self) -> int:
        return len(self.patch_sizes)

    @property
    def shape(self) -> Shape:
        return Shape(self.width, self.height, self.channels)

    def build(self, whitener: Whitener | None = None, first: int = 0) -> list[Layer]:
        """The layers from ``first`` on. Each layer draws from seed + its number."""
        shape, built = self.shape, []
        for i in range(self.layers):
            layer = Layer(
                shape=shape,
                patch=self.patch_sizes[i],
                filters=self.filters[i],
                seed=self.seed + i,
                bandwidth=at(self.bandwidth, i, 1.0),
                stride=at(self.conv_stride, i, 1),
                pad=i in self.zero_pad,
                norm=self.norm,
                norm_offset=self.norm_offset,
                rescale=self.rescale,
                fastfood=i in self.fastfood,
                pool=at(self.pool, i, 1),
                pool_stride=at(self.pool_stride, i, 1),
                pool_kind=self.pool_kind,
                nonlinearity=self.nonlinearity,
                alpha=self.alpha,
                whitener=whitener if i == 0 else None,
            )
            built.append(layer)
            shape = layer.out_shape
        return built[first:]

    def prefix(self, layers: int) -> "FeatureConf":
        """Settings of the first ``layers`` layers, which key their stored output."""
        cut = {
            name: getattr(self, name)[:layers]
            for name in ("patch_sizes", "filters", "bandwidth", "conv_stride", "pool", "pool_stride")
        }
        marks = {
            name: tuple(i for i in getattr(self, name) if i < layers) for name in ("zero_pad", "fastfood", "float_layers")
        }
        if isinstance(self.whiten, tuple):
            cut["whiten"] = self.whiten[:layers]
        return replace(self, **cut, **marks)

    @property
    def feature_id(self) -> str:
        """Hash of the settings, written in one canonical way."""
        text = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))
        return "features_" + hashlib.sha256(text.encode()).hexdigest()[:32]


SOLVERS = ("ridge", "weighted_ridge", "softmax_newton", "softmax_block_newton", "softmax_descent", "log", "log_rest", "hinge")

# Other spellings that run files use.
SOLVER_NAMES = {
    "ls": "ridge",
    "wls": "weighted_ridge",
    "BlockLeastSquares": "ridge",
    "BlockWeightedLeastSquares": "weighted_ridge",
    "softmax": "softmax_newton",
}
FIELD_NAMES = {
    "patch_sizes": "patch_sizes",
    "convStride": "conv_stride",
    "poolStride": "pool_stride",
    "zeroPad": "zero_pad",
    "fastfood": "fastfood",
    "float": "float_layers",
    "insanity": "rescale",
    "nonLinearity": "nonlinearity",
    "whitenerValue": "whitener_epsilon",
    "whitenerOffset": "norm_offset",
    "loadWhitener": "load_whitener",
    "layerToLoad": "layers_to_load",
    "loadLayer": "load_layer",
    "numClasses": "classes",
    "blockSize": "block",
    "numIters": "passes",
    "solverWeight": "mixture",
}


@dataclass(frozen=True)
class SolveConf:
    solver: str = "ridge"
    reg: float = 1e-3
    reg_mode: str = "absolute"
    mixture: float = 0.0
    block: int | None = None
    passes: int = 1
    iterations: int = 20
    classes: int | None = None
    top_k: int = 5

    def __post_init__(self) -> None:
        if self.solver not in SOLVERS:
            raise ValueError(f"solver {self.solver} is none of {SOLVERS}")


def at(values: tuple, i: int, default):
    return values[i] if i < len(values) else default


# Keys of run files that say where and how to run, not what to compute.
RUN_KEYS = (
    "expid", "mode", "layers", "solve", "saveFeatures", "saveModel", "featureDir", "labelDir", "modelDir", "numBlocks", "yarn", "kernelGamma",
    "load_whitener", "layers_to_load", "load_layer", "loss",
)


def known_settings(settings: Mapping) -> dict:
    """The settings under our names; a key that no setting has is an error."""
    known = {FIELD_NAMES.get(key, key): value for key, value in settings.items()}
    names = {item.name for kind in (FeatureConf, SolveConf) for item in fields(kind)} | set(RUN_KEYS)
    odd = sorted(set(known) - names)
    if odd:
        raise ValueError(f"unknown settings {odd}")
    return known


def from_mapping(settings: Mapping) -> tuple[FeatureConf, SolveConf]:
    """Both settings from one flat mapping, in either spelling; unknown keys are an error.

    ``loss`` names the solver where no solver is given. Flags like ``fastfood`` may
    be one boolean for all layers instead of a list of layers.
    """
    known = known_settings(settings)
    known["solver"] = known.get("solver", known.get("loss", SolveConf.solver))
    known["solver"] = SOLVER_NAMES.get(known["solver"], known["solver"])
    layers = len(known.get("patch_sizes", FeatureConf.patch_sizes))
    if known.get("layers", layers) > layers:
        raise ValueError(f"{known['layers']} layers but {layers} patch sizes")
    for name in ("zero_pad", "fastfood", "float_layers"):
        if isinstance(known.get(name), bool):
            known[name] = list(range(layers)) if known[name] else []

    def fill(kind):
        chosen = {}
        for item in fields(kind):
            if item.name in known:
                value = known[item.name]
                if isinstance(value, Mapping):
                    value = [value[key] for key in sorted(value)]
                chosen[item.name] = tuple(value) if isinstance(value, list) else value
        return kind(**chosen)

    features = fill(FeatureConf)
    if "layers" in known:
        features = features.prefix(known["layers"])
    return features, fill(SolveConf)


def run_options(settings: Mapping) -> dict:
    """The arguments of ``runs.run`` that a run file sets: where to go on from and whether to load a whitener."""
    known = known_settings(settings)
    wanted = known.get("load_layer", "layers_to_load" in known)
    return {"layers": known.get("layers_to_load") if wanted else None, "load_whitener": bool(known.get("load_whitener", False))}


def read_yaml(path: str) -> tuple[FeatureConf, SolveConf]:
    """Settings from a YAML file; needs the optional yaml module."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs the yaml module; use from_mapping instead") from missing
    with open(path) as handle:
        return from_mapping(yaml.safe_load(handle))
