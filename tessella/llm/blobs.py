"""Packed blocks of numbers, which the rest of the library uses too."""

from tessella.functions.blobs import BLOB, KINDS, OWN, blob_row, blob_table, dealt, deltas, fingerprints, narrow, packed, undeltas, unpacked

__all__ = ["BLOB", "KINDS", "OWN", "blob_row", "blob_table", "dealt", "deltas", "fingerprints", "narrow", "packed", "undeltas", "unpacked"]
