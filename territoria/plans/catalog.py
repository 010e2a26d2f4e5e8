"""Imports every module that registers queries."""

from . import q_assign, q_checks, q_clustering, q_geo, q_ingest, q_layers, q_misc, q_reports, q_routing, q_stored, q_stream, q_tables, q_text  # noqa: F401
