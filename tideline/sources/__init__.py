"""Readers that turn feeds, pages and bulk files into item rows."""
