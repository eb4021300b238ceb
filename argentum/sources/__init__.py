"""Readers and writers of media files, sidecars, catalogs and reports."""
