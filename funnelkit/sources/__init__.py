from funnelkit.sources.binding import BINDING_SQL, Tables, load_tables
from funnelkit.sources.readers import read_table, write_csv, write_table

__all__ = ["BINDING_SQL", "Tables", "load_tables", "read_table", "write_csv", "write_table"]
