"""Settings that define the semantics of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults are fixed values: results only agree with published ones when they are kept."""

    # vectors
    dim: int = 384
    # routing
    s_min: float = 0.60
    mass_weight: float = 0.2
    threshold_decay: float = 0.15
    threshold_min_log: float = 0.1
    # buffers and batches
    buffer_threshold: int = 3
    batch_rows: int = 64
    # training
    training_threshold: int = 12
    training_delta: float = 2.0
    min_training_texts: int = 12
    max_training_texts: int = 100
    training_batch_size: int = 32
    learning_rate_base: float = 1e-4
    lr_reference_batch: int = 4
    inheritance_lr_multiplier: float = 0.3
    inheritance_l2_base: float = 0.01
    inheritance_l2_boost: float = 1.5
    strict_similarity: float = 0.70
    life_insurance: float = 2.0
    # fusion
    fusion_similarity: float = 0.60
    fusion_max_mass: int = 15
    fusion_max_variance: float = 0.5
    fusion_variance_increase: float = 0.1
    micro_max_mass: int = 12
    micro_similarity: float = 0.55
    # parents
    titan_min_mass: int = 20
    titan_max_variance: float = 0.5
    titan_similarity: float = 0.55
    adoption_similarity: float = 0.60
    late_binding_similarity: float = 0.75
    re_evaluation_similarity: float = 0.70
    # feedback
    feedback_high: float = 0.85
    feedback_low: float = 0.50
    feedback_eta: float = 0.05
    # quarantine
    quarantine_hours_first: float = 48.0
    quarantine_hours_later: float = 168.0
    quarantine_cap: int = 10
    quarantine_forced_at: int = 3
    # evaluation
    validation_split: float = 0.2
    eval_batch_size: int = 4
    eval_min_texts: int = 1
    # artifacts
    artifact_formats: tuple[str, ...] = ("safetensors", "bin")
    artifact_max_bytes: int = 50 * 1024 * 1024
    # physical limits of the similarity join (do not change results)
    broadcast_bytes: int = 128 * 1024 * 1024
    tile_rows: int = 100_000
    group_rows: int = 100_000
    tile_bytes: int = 128 * 1024 * 1024
    max_pivots: int = 512
    # physical limits of the iterative operators (do not change results)
    neighbour_list: int = 16
    leader_list: int = 64
    leader_head_rows: int = 4096
    leader_task_rows: int = 16384
