"""Plans composed of operators: clinical labels, statistics, comparisons, registered queries."""
