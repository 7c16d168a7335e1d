"""canopy: analytics over file trees, archives and read-only images as Spark DataFrames."""
