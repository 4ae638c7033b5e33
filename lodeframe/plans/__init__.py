"""The dialect: text to syntax tree to Spark plan."""
