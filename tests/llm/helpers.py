"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def write_tables(spark, folder, **tables):
    """Tables as <folder>/<name>.parquet, for queries that take an sf_dir."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


LONG = "The quick brown fox jumps over the lazy dog near the river bank today. " * 3000
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (7, "naïve ≠ ASCII 😀 text"), (None, "no id"), (8, "\x00 nul\x0b")]
