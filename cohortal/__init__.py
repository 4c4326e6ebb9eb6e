"""Group statistics, clustering and lineage over large tables, as Spark plans."""
