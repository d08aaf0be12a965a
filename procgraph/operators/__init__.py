"""Relational, graph, tree, text and rule operators: DataFrame in, DataFrame out, generic over columns."""
