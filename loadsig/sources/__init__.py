"""Readers and writers of readings, parameters, day types and trees."""
