"""Column builders: parsing, vectors, formulas, statistics, text. They stay in the JVM and in generated code where Spark allows."""
