"""Operations of a large-scale training-data pipeline, as Spark jobs.

Each module holds one operator with its own interface; :mod:`tonegrid.llm.queries` applies
them to the shared test tables.  Nothing outside this subpackage imports it.
"""
