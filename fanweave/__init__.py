"""Transfer planning, exactly-once accounting and corpus tooling on Spark DataFrames."""
