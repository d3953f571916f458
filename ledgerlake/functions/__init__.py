"""Scalar codecs and checksums."""
