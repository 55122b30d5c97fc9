"""Readers that give documents: files, JSON lines, markdown sections, stored pages."""
