"""Sources give `doc_id, text, source_rank, ord`; sinks write and read the engine's tables.

`(source_rank, ord)` is the arrival order of a document. Everything that depends on order
(limits, samples, ties) sorts by it, because a distributed table has no order of its own.
"""
