"""All registered queries: importing this module fills the registry."""

from orbitweave.jobs import calibrated, consistency, epochs, estimation, fits, following, machine_tables, momenta, planning, plans, preparation, tables
from orbitweave.jobs.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "calibrated", "consistency", "epochs", "estimation", "fits", "following", "machine_tables", "momenta", "planning", "plans", "preparation", "tables"]
