"""Readers that turn raw index, history, fact and document files into tables, and writers."""
