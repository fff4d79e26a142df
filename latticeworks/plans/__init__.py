"""Whole analyses, and the queries with their SQL that check each operator."""
