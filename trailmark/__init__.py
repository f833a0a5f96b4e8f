"""Spark-native place, timetable, route and motion analytics."""
