"""Readers and writers: plans, campus maps, timetables, recordings, keyed tables."""
