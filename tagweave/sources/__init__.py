"""Landed JSON, embedding tables and parquet tables."""
