"""Readers and writers. Readers take explicit schemas; writers append or replace whole partitions."""
