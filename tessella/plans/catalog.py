"""Imports every query module so that the registry is complete."""

from tessella.plans import q_files, q_matrix, q_membership, q_motifs, q_networks, q_regulators, q_runs, q_scores  # noqa: F401
from tessella.plans.registry import REGISTRY  # noqa: F401
