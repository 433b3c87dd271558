"""Sources and sinks: driver tables mapped onto the package's data model."""
