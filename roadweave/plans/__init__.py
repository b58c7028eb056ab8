"""Views that adapt the test tables, and the registered queries with their SQL."""
