"""Column-level helpers: quoting, dtype split, and pure cleaning expressions (SURVEY B*)."""
