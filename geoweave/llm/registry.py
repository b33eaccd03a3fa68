"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import bpe, exact_dedup, extract, license_scan, mixing, mjpeg, simhash, substring_dedup, toxicity, warc

_MODULES = (mjpeg, license_scan, exact_dedup, simhash, extract, warc, toxicity, substring_dedup, bpe, mixing)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
