"""All registered queries. Importing a module registers what it declares."""

from . import bind_model, bind_text, q_assemble, q_edit, q_flows, q_graph, q_match, q_models, q_runs, q_sources, q_text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
