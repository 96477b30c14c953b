"""Sources and sinks: field tables, catalogs of models, sites in CSV, region files, results."""
