"""Readers: corpus files, navigation files, catalogues, lexicons and text logs."""
