"""Operations of a large training-data pipeline, one module per operator.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; :mod:`rollcall.llm.queries` applies them to the tables.
"""
