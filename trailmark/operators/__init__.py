"""Operators over DataFrames of places, timetables, routes and motion."""
