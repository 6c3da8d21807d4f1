"""Reading sheets, tables and schemas; writing records, templates and artifacts."""
