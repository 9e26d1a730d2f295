"""Operators for preparing text corpora (deduplication, filters, scans,
tokenization).  Nothing else in the package imports this one."""
