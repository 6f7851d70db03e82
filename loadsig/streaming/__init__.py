"""Scoring of arriving readings with Structured Streaming."""
