"""Analysis operators: (Tables, Params) -> DataFrame."""
