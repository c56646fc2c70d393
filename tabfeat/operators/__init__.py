"""Table operators. Stateful ones learn their state in one aggregation and apply it as a projection."""
