"""Query plans: what ``__spark_entry__`` registers, with the SQL that each is held against."""
