"""Column expressions and their Python twins: wire values, object types, versions, dates, COPY text."""
