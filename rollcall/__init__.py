"""Rollcall: contact resolution as Spark jobs."""
