"""Writers: routed tables, evolving tables, layout, compaction, registry, export documents."""
