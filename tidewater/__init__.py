"""tidewater: entity-by-date panel analytics written as Spark jobs."""

__version__ = "0.1.0"
