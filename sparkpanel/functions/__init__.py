"""Column functions: text predicates, extraction, perturbation and statistics, all evaluated in the JVM."""
