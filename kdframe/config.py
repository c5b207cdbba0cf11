"""Parameter sets of the distillation scripts as frozen dataclasses.

Fixed values (must equal the source scripts for identical results):
  default system prompt             "You are a helpful assistant."
  fixed system prompt (hidden KD)   "You are a helpful assistant chatbot."
  ChatML markers                    "<|im_start|>", "<|im_end|>"
  DPO completion suffix             "<|im_end|>n"
  stop sequences                    "\\nQ:", "\\nQuestion:", "\\nA:"
  shot settings                     "0-shot": 0, "1-shot": 1, "3-shot": 3
  dataset names in summaries        "GSM8K", "ARC-Challenge"
  distillation temperature / alpha  2.0 / 0.5
  max_length                        4096 (logit and hidden KD), 1024 (control/cascade)
  seed                              42
  test split                        0.1 (KD), 0.05 (DPO)
  DPO batch KD weight               0.001 with temperature 1.0
  shot pool size                    max(50, n)
  evaluation items                  50 GSM8K, 50 ARC, 64 new tokens
  ignore index                      -100
"""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_SYSTEM = "You are a helpful assistant."
FIXED_SYSTEM = "You are a helpful assistant chatbot."
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
DPO_SUFFIX = "<|im_end|>n"
STOP_SEQS = ("\nQ:", "\nQuestion:", "\nA:")
SHOTS = (("0-shot", 0), ("1-shot", 1), ("3-shot", 3))
GSM_NAME = "GSM8K"
ARC_NAME = "ARC-Challenge"
IGNORE_INDEX = -100
SEED = 42


@dataclass(frozen=True)
class DistillConfig:
    temperature: float = 2.0
    alpha: float = 0.5
    max_length: int = 4096
    seed: int = SEED
    test_size: float = 0.1
    epochs: int = 3
    batch_size: int = 1
    grad_accum: int = 8


@dataclass(frozen=True)
class DPOConfig:
    beta: float = 0.1
    kd_weight: float = 1e-3
    kd_temperature: float = 1.0
    val_split: float = 0.05
    rpo_alpha: float | None = None
    aux_loss_coef: float = 0.0
    truncation_mode: str = "keep_end"
    max_length: int | None = None
    suffix: str = DPO_SUFFIX


@dataclass(frozen=True)
class EvalConfig:
    gsm_samples: int = 50
    arc_samples: int = 50
    shots: tuple = SHOTS
    max_new_tokens: int = 64
    pool_min: int = 50
    seed: int = SEED
    stops: tuple = STOP_SEQS
