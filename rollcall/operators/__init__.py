"""Screening, resolution, lineage, profiles, lookup, intake and readings over DataFrames."""
