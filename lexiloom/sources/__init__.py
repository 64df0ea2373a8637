"""Readers and writers: tables, line corpora, chat pairs, token files, metadata and models."""
