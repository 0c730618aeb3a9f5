"""Registered queries: each module has QUERIES (name -> callable) and SQL (name -> the same in SQL)."""
