"""logweave: log parsing, template mining, log search and answer scoring as Spark jobs."""
