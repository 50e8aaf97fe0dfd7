"""Training-data operators: dedup, scans, scoring, decontamination, token files and packing.

Nothing outside this subpackage imports it.
"""
