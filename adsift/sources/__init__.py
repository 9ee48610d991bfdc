"""Readers and writers for corpora, reports, keyword files and models."""
