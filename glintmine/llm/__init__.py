"""Training-data operators: language ID, packing, secret scans, quality rules, HTML extraction,
URL filters, benchmark decontamination, near-duplicate join, toxicity and substring dedup.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
