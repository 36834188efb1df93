"""Sources and sinks: driver tables, domain views, dimensions, file IO."""
