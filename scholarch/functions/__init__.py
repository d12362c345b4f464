"""Column functions: every one maps Columns to a Column and stays inside codegen,
except the few pandas UDFs in `phonetic`, `similarity` and `json_text`."""
