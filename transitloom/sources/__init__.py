"""Readers of catalogs, route payloads, caches and command files, and writers of tables and maps."""
