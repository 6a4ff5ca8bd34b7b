"""Readers for catalog tables and file datasets."""
