"""Training-data operators: token counts, mixing, deduplication, formatting,
language and quality models, decontamination and licence scans.

Nothing outside this subpackage (and the pipeline script beside it) imports it.
"""
