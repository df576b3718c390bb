"""Readers that make tables of files, symbols and relations."""
