"""Journeys, dated networks and timetables as Spark DataFrames."""
