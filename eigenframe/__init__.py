"""Multivariate analysis of tables and streams on Spark."""

from eigenframe.operators.gappy import fit_pca_missing, score_missing
from eigenframe.operators.kernel import KernelParams, fit_kernel_pca, score_kernel
from eigenframe.operators.lagged import fit_lagged_pca, score_lagged
from eigenframe.operators.pca import PCAModel, fit_pca
from eigenframe.operators.regression import CV, fit_pcr
from eigenframe.operators.rowstage import RowStage
from eigenframe.operators.scoring import predict, reconstruct, score
from eigenframe.roles import Roles
from eigenframe.sources.models import load_model, save_model
from eigenframe.sources.tables import read_table, write_table

__all__ = [
    "CV",
    "KernelParams",
    "PCAModel",
    "Roles",
    "RowStage",
    "fit_kernel_pca",
    "fit_lagged_pca",
    "fit_pca",
    "fit_pca_missing",
    "fit_pcr",
    "load_model",
    "predict",
    "read_table",
    "reconstruct",
    "save_model",
    "score",
    "score_kernel",
    "score_lagged",
    "score_missing",
    "write_table",
]
