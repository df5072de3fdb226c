"""DataFrame-to-DataFrame operators: filters, sorting, rollups, log snapshots, joins, reshaping."""
