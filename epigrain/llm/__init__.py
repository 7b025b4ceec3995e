"""Operators for building training corpora: de-duplication, filtering, extraction, packing and binary output."""
