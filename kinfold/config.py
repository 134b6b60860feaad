"""Settings of one encoder run."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from kinfold.functions.vectors import ACTIVATIONS
from kinfold.operators.losses import LOSSES
from kinfold.operators.noise import CORRUPTIONS

OPTIMIZERS = ("gradient_descent", "momentum", "ada_grad", "adam")
STRATEGIES = ("batch_all", "batch_hard", "none")


@dataclass(frozen=True)
class EncoderConfig:
    """Defaults are those of the command-line pipeline; any of them may be changed."""

    model_name: str = "dae"
    compress_factor: float = 20
    enc_act_func: str = "sigmoid"
    dec_act_func: str = "sigmoid"
    loss_func: str = "cross_entropy"
    num_epochs: int = 50
    batch_size: float = 0.1
    xavier_init: float = 1.0
    opt: str = "gradient_descent"
    learning_rate: float = 0.1
    momentum: float = 0.5
    corr_type: str = "masking"
    corr_frac: float = 0.3
    verbose_step: int = 5
    seed: int = 42
    alpha: float = 1.0
    triplet_strategy: str = "batch_all"
    hard_mode: str = "reference"
    hash_method: str = "xxhash64"
    tile_rows: int = 1024
    validation_batch: float | None = None  # rows, or a share of them; None: all as one batch
    max_parameter_bytes: int = 1 << 30  # larger parameters are trained as a table of blocks
    block_bytes: int = 8 << 20

    def __post_init__(self):
        choices = {
            "enc_act_func": tuple(ACTIVATIONS),
            "dec_act_func": tuple(ACTIVATIONS),
            "loss_func": LOSSES,
            "opt": OPTIMIZERS,
            "corr_type": CORRUPTIONS,
            "triplet_strategy": STRATEGIES,
            "hard_mode": ("reference", "strict"),
            "hash_method": ("xxhash64", "md5"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {getattr(self, name)!r}")
        if self.batch_size <= 0 or self.num_epochs < 0 or not 0 <= self.corr_frac <= 1:
            raise ValueError("batch_size must be positive, num_epochs not negative, corr_frac in [0, 1]")

    def components(self, n_features: int) -> int:
        return math.floor(n_features / self.compress_factor)

    def params(self) -> dict:
        return asdict(self)
