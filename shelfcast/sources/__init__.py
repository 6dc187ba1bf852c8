from .tables import (DRIVER_TABLES, load_tables, read_table, table_counts,  # noqa: F401
                     schema_rows, sample_rows)
from .files import (read_csv_table, read_json_records, load_csv_dir,  # noqa: F401
                    bulk_load, write_table, ORDER_LIFECYCLE_SCHEMAS, PARTS_SCHEMAS)
