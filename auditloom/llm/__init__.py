"""Training-data operators: dedup, scans, formatting, search, scoring, tokens, media, mixing.

Each module holds one operator with a general interface; ``queries.py`` holds
the thin ``opN_<name>`` queries and ``sql.py`` the SQL that DuckDB can run.
"""
