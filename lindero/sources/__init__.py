"""Landed responses, listings and files; result sinks."""
