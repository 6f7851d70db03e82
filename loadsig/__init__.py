"""Energy-signature analytics on hourly meter readings, as Spark jobs.

Every operator takes and returns DataFrames and is keyed by ``building_id``,
so one job serves a whole portfolio of buildings.
"""
