"""Queries of the library over the star-schema tables, with their SQL."""

from . import q_agenda, q_building, q_climb, q_explore, q_gate, q_more, q_motion, q_places, q_replay, q_rest, q_routes, q_text, q_timetable  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
