"""Table operators: relabelling, log shaping, aggregation, series functions, views, alerts, export."""
