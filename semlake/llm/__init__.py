"""Training-data operators: scans, near-duplicates, token counts, mixing, archives and privacy over document tables.

Nothing outside this subpackage imports it.  Shared conventions:

* intermediate results that are read more than once are written as Parquet under ``spark.checkpoint.dir``
  (see :mod:`semlake.llm.common`), so losing an executor costs a task and never the lineage;
* joins on keys that may be hot put the aggregated side through a round-robin exchange first
  (:func:`semlake.llm.common.respread`), so both inputs are plain shuffles and AQE can split the hot partition.
"""
