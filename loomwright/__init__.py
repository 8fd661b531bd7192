"""Declarative dataset assembly on Spark."""

from .api import infer, load, to_spec, validate
from .errors import AssemblyError, DataError, JoinError, SpecError
from .plans.planner import Dataset, assemble
from .spec.model import DatasetSpec

__all__ = ["AssemblyError", "DataError", "Dataset", "DatasetSpec", "JoinError", "SpecError", "assemble", "infer", "load", "to_spec", "validate"]
