"""Readers and writers: catalogue CSV, JSON lines and documents, file trees, archives, image headers."""
