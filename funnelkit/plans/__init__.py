"""Parameters, the registry of named analyses, their SQL twins and session helpers."""
