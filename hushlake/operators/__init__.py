"""Jobs over tables: search, index upkeep, rotation, private aggregates, screening, audit."""
